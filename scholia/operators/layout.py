"""Operators on intervals and boxes: containment, best overlap, attribution, clusters, packing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .graph import components, cut

_XY = ("x0", "y0", "x1", "y1")


def containing(points: DataFrame, units: DataFrame, keys: list[str], y: str, y0: str, y1: str, unit: str, snap: float, bin_size: int) -> DataFrame:
    """For each point the first unit that contains it, else the nearest within ``snap``; points without one drop out.

    Units are put into every bin of ``bin_size`` that they reach, points into their own, so that the join is one of
    equality and no pair outside a bin is formed.
    """
    lo, hi = (F.floor((F.col(y0) - snap) / bin_size), F.floor((F.col(y1) + snap) / bin_size))
    binned = units.withColumn("__bin", F.explode(F.sequence(lo, hi)))
    near = points.withColumn("__bin", F.floor(F.col(y) / bin_size)).join(binned, "__bin").where(F.col(y).between(F.col(y0) - snap, F.col(y1) + snap))
    off = F.greatest(F.col(y0) - F.col(y), F.col(y) - F.col(y1), F.lit(0))
    w = Window.partitionBy(*keys).orderBy(F.when(F.col(y).between(F.col(y0), F.col(y1)), 0).otherwise(1), off, unit)
    return near.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__bin")


def best_iou(a: DataFrame, b: DataFrame, keys: list[str], unit: str, least: float) -> DataFrame:
    """Every row of a with the row of b that overlaps it most (match_id, iou), if any by at least ``least``."""
    other = b.select(*keys, F.col(unit).alias("match_id"), *(F.col(c).alias("__" + c) for c in _XY))
    pairs = a.join(other, keys).withColumn("iou", G.iou([F.col(c) for c in _XY], [F.col("__" + c) for c in _XY])).where(F.col("iou") >= least)
    best = pairs.groupBy(*keys, unit).agg(F.min(F.struct((-F.col("iou")).alias("n"), "match_id")).alias("m")).select(*keys, unit, "m.match_id", (-F.col("m.n")).alias("iou"))
    return a.join(best, [*keys, unit], "left")


def attributed(groups: DataFrame, units: DataFrame, page: str, line_height: float, zone: float, reach: float = 1.5, back: float = 1.0, below: float = 0.7, above: float = 1.0, tie: float = 0.3) -> DataFrame:
    """The unit each group belongs to: least weighted height apart; inside the tie band by zone, then by width apart."""
    g = groups.select(page, F.col("id").alias("group_id"), F.col("x0").alias("gx"), F.col("y0").alias("gy"))
    u = units.select(page, F.col("id").alias("unit_id"), F.col("x0").alias("ux"), F.col("y0").alias("uy"))
    dy = F.col("gy") - F.col("uy")
    cand = g.join(u, page).where((F.abs(dy) <= reach * line_height) & (F.col("gx") >= F.col("ux") - back * line_height))
    cand = cand.withColumn("dist", F.abs(dy) * F.when(dy > 0, below).otherwise(above)).withColumn("hd", F.abs(F.col("gx") - F.col("ux"))).withColumn("out", F.when(F.col("gx") <= F.col("ux") + zone, 0).otherwise(1))
    own = Window.partitionBy(page, "group_id")
    ring = cand.withColumn("best", F.min("dist").over(own)).where(F.col("dist") <= F.col("best") + tie * line_height)
    return ring.withColumn("r", F.row_number().over(own.orderBy("out", "hd", "unit_id"))).where("r = 1").select(page, "group_id", "unit_id", "dist", "hd")


def clusters(boxes: DataFrame, page: str, radius: int | Column, parts: int, ink: int | Column) -> DataFrame:
    """Groups of boxes that touch once grown by ``radius``, over any number of boxes, inside each page.

    ``radius`` may be a column of the boxes, and ``ink`` one of the clusters' (page, parts, ink, box).

    Pages are small and many, so links are joined by page.
    """
    b = boxes.where("kind <> 'underline'")
    named = named_clusters(b, page, radius if isinstance(radius, Column) else F.lit(radius))
    out = b.join(named, [page, "id"]).groupBy(page, "cluster").agg(F.count("*").alias("parts"), F.sum("n").alias("ink"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return out.where((F.col("parts") >= parts) & (F.col("ink") >= ink))


def named_clusters(boxes: DataFrame, page: str, radius: Column) -> DataFrame:
    """page, id, cluster (the smallest id of the cluster) of all boxes but underlines."""
    b = boxes.where("kind <> 'underline'")
    o = b.select(page, F.col("id").alias("o"), *(F.col(c).alias("o" + c) for c in _XY))
    r = 2 * radius
    near = (F.col("x0") - r <= F.col("ox1")) & (F.col("ox0") - r <= F.col("x1")) & (F.col("y0") - r <= F.col("oy1")) & (F.col("oy0") - r <= F.col("y1"))

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        up = {i: i for i in pdf["id"]}

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for i, j in zip(pdf["id"], pdf["o"], strict=True):
            a, c = sorted((top(i), top(j)))
            up[c] = a
        ids = sorted(up)
        return pd.DataFrame({page: pdf[page].iloc[0], "id": ids, "cluster": [top(i) for i in ids]})

    return b.join(o, page).where(near & (F.col("id") <= F.col("o"))).select(page, "id", "o").groupBy(page).applyInPandas(label, f"{page} long, id long, cluster long")


def writing_clusters(boxes: DataFrame, page: str, height: str, gap: float = 0.5, parts: int = 3, share: float = 0.8) -> DataFrame:
    """Clusters of handwriting by the page's line height: boxes within 2r, r half a line; at least ``parts`` boxes and an ink of .8 h^2.

    page, cluster, parts, ink, long_ink (of boxes of 2.2 lines and more), the box and the line height.
    """
    radius = F.greatest(F.lit(1), F.floor(F.col(height) * gap + 0.5))
    named = named_clusters(boxes, page, radius)
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 1
    g = boxes.join(named, [page, "id"]).groupBy(page, "cluster").agg(
        F.count("*").alias("parts"), F.sum("n").alias("ink"), F.coalesce(F.sum(F.when(side >= 2.2 * F.col(height), F.col("n"))), F.lit(0)).alias("long_ink"), *(F.min(c).alias(c) for c in ("x0", "y0")), *(F.max(c).alias(c) for c in ("x1", "y1")), F.first(height).alias(height)
    )
    return g.where((F.col("parts") >= parts) & (F.col("ink") >= F.floor(share * F.col(height) * F.col(height) + 0.5)))


def cluster_verdict(clusters: DataFrame, height: str) -> DataFrame:
    """Clusters judged wrong: confidence .9, .78 or .6 by strength and by how much of the ink is long lines, and whether to look again."""
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    density, lines = F.col("ink") / F.greatest(F.lit(1), w * h), F.col("long_ink") / F.greatest(F.lit(1), F.col("ink"))
    strong = (F.col("parts") >= 8) | (F.col("ink") >= 2 * F.col(height) * F.col(height))
    weak = ~strong & ((F.col("parts") < 5) | (density < 0.01) | (density > 0.35))
    sure = F.when(strong, F.when(lines > 0.7, 0.78).otherwise(0.9)).when(weak, 0.6).otherwise(0.78)
    return clusters.withColumn("verdict", F.lit("wrong")).withColumn("confidence", sure).withColumn("suspect", weak | ((lines > 0.85) & ~strong))


def merged_blocks(boxes: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Blocks of a column merged in order of y0 while their heights overlap the running block by ``least`` (IoU): keys, block, parts, box.

    Whether a box joins hangs on the box so far, so a column is folded in order; a column is one page's.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, cur = [], None
        for b in pdf.sort_values(["y0", "id"]).itertuples():
            if cur is not None:
                both, all_ = min(cur[3], b.y1) - max(cur[1], b.y0) + 1, max(cur[3], b.y1) - min(cur[1], b.y0) + 1
                if both > 0 and both / all_ >= least:
                    cur = [min(cur[0], b.x0), min(cur[1], b.y0), max(cur[2], b.x1), max(cur[3], b.y1), cur[4], cur[5] + 1]
                    continue
                out.append(cur)
            cur = [b.x0, b.y0, b.x1, b.y1, b.id, 1]
        out.append(cur)
        frame = pd.DataFrame(out, columns=[*_XY, "block", "parts"])
        return frame.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "block", "parts", *_XY]]

    kind = ", ".join(f"{k} long" for k in (*keys, "block", "parts", *_XY))
    return boxes.select(*keys, "id", *_XY).groupBy(*keys).applyInPandas(fold, kind)


def otsu(hist: DataFrame, groups: list[str], level: str, count: str) -> DataFrame:
    """Threshold of largest between-class variance of each group's histogram; a plateau gives its middle."""
    upto = Window.partitionBy(*groups).orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*groups)
    x = hist.withColumn("n0", F.sum(count).over(upto)).withColumn("s0", F.sum(F.col(count) * F.col(level)).over(upto)).withColumn("n", F.sum(count).over(whole)).withColumn("s", F.sum(F.col(count) * F.col(level)).over(whole))
    n1 = F.col("n") - F.col("n0")
    var = F.when(n1 > 0, F.round(F.col("n0") * n1 * F.pow(F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / n1, F.lit(2)) / F.pow(F.col("n"), F.lit(2)), 9)).otherwise(0.0)
    best = x.withColumn("var", var).withColumn("most", F.max("var").over(whole)).where("var = most")
    return best.groupBy(*groups).agg(F.floor((F.min(level) + F.max(level)) / 2).cast("long").alias("threshold"), F.max("var").alias("variance"))


def rows_of_lines(boxes: DataFrame, page: str, share: float = 0.6) -> DataFrame:
    """Visual rows: boxes by middle height join the row whose head is near enough (a share of the page's median
    height, or their own if that is less), else begin one; inside a row by x."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(cy=(pdf["y0"] + pdf["y1"]) / 2, h=(pdf["y1"] - pdf["y0"]).clip(lower=1)).sort_values(["cy", "x0", "id"])
        row, head, out, usual = -1, None, [], pdf["h"].median()
        for cy, h in zip(pdf["cy"], pdf["h"], strict=True):
            if head is None or abs(cy - head) > share * min(h, usual):
                row, head = row + 1, cy
            out.append(row)
        pdf = pdf.assign(row=out).sort_values(["row", "x0", "id"])
        return pdf.assign(place=range(len(pdf)))[[page, "id", "row", "place"]]

    return boxes.select(page, "id", *_XY).groupBy(page).applyInPandas(fold, f"{page} long, id long, row long, place long")


def packed(items: DataFrame, page: str, width: int, height: int) -> DataFrame:
    """Rectangles on sheets: best short side fit, guillotine cuts, tallest first."""

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        free, out, sheet = [], [], -1
        for r in pdf.sort_values(["h", "w", "id"], ascending=[False, False, True]).itertuples():
            w, h = min(r.w, width), min(r.h, height)
            fits = [(min(fw - w, fh - h), max(fw - w, fh - h), k) for k, (_, _, _, fw, fh) in enumerate(free) if fw >= w and fh >= h]
            if not fits:
                sheet += 1
                free.append((sheet, 0, 0, width, height))
                fits = [(0, 0, len(free) - 1)]
            s, x, y, fw, fh = free.pop(min(fits)[2])
            out.append((getattr(r, page), r.id, s, x, y))
            if fw - w > fh - h:  # the cut leaves the larger piece whole
                free += [(s, x + w, y, fw - w, fh), (s, x, y + h, w, fh - h)]
            else:
                free += [(s, x + w, y, fw - w, h), (s, x, y + h, fw, fh - h)]
            free = [f for f in free if f[3] > 0 and f[4] > 0]
        return pd.DataFrame(out, columns=[page, "id", "sheet", "x", "y"])

    return items.groupBy(page).applyInPandas(place, f"{page} long, id long, sheet long, x long, y long")


# Shortest run of ink that isn't noise, and the fewest runs that tell a width.
SHORTEST_RUN, FEWEST_RUNS = 2, 24


def stroke_width(ink: DataFrame, image: str, longest: int) -> DataFrame:
    """image, runs, width: the mean of the 40th and the 60th percentile of the horizontal runs of ink (x, y) of each image.

    Runs of one pixel are noise, those longer than ``longest`` are rules; with fewer than 24 others the width is 0.  The
    percentile p of n sorted runs is that of index floor(p n), from 0.  Pixels may repeat.  Rows of pixels are spread over
    tasks, and runs are counted by length before they meet by image, so at most ``longest`` counts of an image do.
    """
    row = Window.partitionBy(image, "y").orderBy("x")
    runs = ink.select(image, "y", "x").distinct().withColumn("start", F.col("x") - F.row_number().over(row)).groupBy(image, "y", "start").agg(F.count("*").alias("n"))
    kept = F.col("n").between(SHORTEST_RUN, longest)
    sizes = runs.groupBy(image, F.when(kept, F.col("n")).alias("n")).agg(F.count("n").alias("c"))
    sizes = sizes.where("n IS NOT NULL").unionByName(runs.select(image).distinct().select(image, F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("c")))
    sizes = sizes.withColumn("upto", F.sum("c").over(Window.partitionBy(image).orderBy("n"))).withColumn("runs", F.sum("c").over(Window.partitionBy(image)))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("runs") * p), F.col("n")))
    g = sizes.groupBy(image).agg(F.max("runs").alias("runs"), ((at(0.4) + at(0.6)) / 2).alias("width"))
    return g.withColumn("width", F.when(F.col("runs") >= FEWEST_RUNS, F.col("width")).otherwise(0.0))


#: Columns of a tile, in which runs of neighbouring rows meet, and bits of a coordinate in a run's name.
TILE, COORDINATE_BITS = 64, 20


def ink_runs(ink: DataFrame, image: str) -> DataFrame:
    """image, y, x0, x1: the runs of ink (image, x, y; repeated pixels count once) in every row."""
    along = Window.partitionBy(image, "y").orderBy("x")
    start = (F.col("x") - F.row_number().over(along)).alias("start")
    return ink.select(image, "x", "y").distinct().select(image, "x", "y", start).groupBy(image, "y", "start").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("start")


def ink_components(ink: DataFrame, image: str) -> DataFrame:
    """image, label (from 0, by first pixel), x0, y0, x1, y1, n (pixels): the regions of ink that hang together, corners included.

    Runs of a row are the nodes; a run touches those of the row above that begin at most one pixel behind it and end at
    most one before it.  They meet in tiles of the row, so a row's runs aren't paired with each other; labels then jump
    (``graph.components``), so a long region takes few rounds.  Images may be of any number; coordinates are from 0 to 2^20 - 1,
    images are integers.  Null coordinates are no pixels; an empty table has no regions.
    """
    name = F.col(image).cast("long") * (1 << 2 * COORDINATE_BITS) + F.col("y") * (1 << COORDINATE_BITS) + F.col("x0")
    runs = cut(ink_runs(ink.where("x IS NOT NULL AND y IS NOT NULL"), image).withColumn("run", name))
    tiles = lambda reach: F.explode(F.sequence(F.floor((F.col("x0") - reach) / TILE), F.floor((F.col("x1") + reach) / TILE)))
    below = runs.select(image, "y", "x0", "x1", "run", tiles(1).alias("tile"))
    above = runs.select(image, (F.col("y") + 1).alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("run").alias("up"), tiles(0).alias("tile"))
    touch = below.join(above, [image, "y", "tile"]).where((F.col("a0") <= F.col("x1") + 1) & (F.col("a1") >= F.col("x0") - 1)).select("run", "up").distinct()
    comp = components(touch, "run", "up").withColumnRenamed("node", "run")
    whole = runs.join(comp, "run", "left").groupBy(image, F.coalesce("comp", "run").alias("comp")).agg(
        F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"), F.sum(F.col("x1") - F.col("x0") + 1).alias("n")
    )
    return whole.withColumn("label", F.row_number().over(Window.partitionBy(image).orderBy("comp")) - 1).select(image, "label", "x0", "y0", "x1", "y1", "n")
