"""Where on a page the questions of given numbers stand, and one text of several readings of the same spot."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How a line shows the number of its question, a solution, an option, a figure's caption.  They are written
# without look-ahead, which the SQL beside the queries hasn't got.
BRACKETED = r"^\s*【\s*(?:例|例题|练习|习题)?\s*(\d{1,3})\s*】"
ORDINAL, ORDINAL_FIGURE = r"^\s*第\s*(\d{1,3})\s*题", r"^\s*第\s*\d{1,3}\s*题\s*图"
SEPARATED = r"^\s*(\d{1,3})\s*[．。、，,：:）)】\].](?:[^0-9]|$)"
BARE = r"^\s*(\d{1,3})\s*(?:[.．。、，,：:）)】\]](?:[^0-9]|$)|[一-龥A-Za-z△▲□○（(《【]|$)"
SOLUTION = r"^\s*(?:【\s*(?:答案|解析|解答|解)\s*】|(?:答案|解析|解答)\s*[：:]|解\s*[：:])"
OPTION = r"^\s*[A-DＡ-Ｄ]\s*[.．、,，)）]"
SUB = r"(?:[（(]\s*\d{1,2}\s*[)）]|[①②③④⑤⑥⑦⑧⑨⑩])"
CAPTION = rf"第\s*(\d{{1,3}})\s*(?:{SUB}\s*)?题\s*(?:{SUB}\s*)?图"
FIGURE_LINE = rf"{CAPTION}|^\s*图\s*\d{{1,3}}\s*$"
# Highest number, share of the column's width that print has, lines that make a note, paddings.
HIGHEST, PRINT_SHARE, NOTE_LINES, PAD, PAD_LINE, PAD_PAGE = 300, 0.6, 3, 4, 0.5, 0.02


def _found(s: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(s, pattern, 1), F.lit("")).cast("int")


def question_number(s: Column) -> Column:
    """Number that a line begins with, 1 to 300, else null; decimals and captions aren't numbers of questions."""
    known = [_found(s, BRACKETED), F.when(~s.rlike(ORDINAL_FIGURE), _found(s, ORDINAL)), _found(s, SEPARATED)]
    return F.coalesce(*(F.when(n.between(1, HIGHEST), n) for n in known))


def located(lines: DataFrame, wanted: DataFrame, figures: DataFrame, width: int, height: int) -> DataFrame:
    """page, label, located, the box of each wanted question, solution (its y, or null), n_figures; in shares of the page.

    lines: page, col, id, x0, y0, x1, y1, body, where a body of several lines is cut into lines of equal height; wanted:
    page, label; figures: page, fx0, fy0, fx1, fy1, label (null: none declared).  A question reaches from its number to the next
    one in its column, less the notes at its end and other questions' captions.  A number that's wanted but shown by no
    line counts where a line begins with it bare; one that isn't found at all gets the whole page.  Null bodies are empty.
    """
    one = F.split(F.coalesce("body", F.lit("")), "\n")
    x = lines.withColumn("n", F.size(one)).select("page", "col", "id", "x0", "y0", "x1", "y1", "n", F.posexplode(one).alias("pos", "s"))
    x = x.repartition("page")  # once: all windows below are within a page
    step = (F.col("y1") - F.col("y0")) / F.col("n")
    x = x.select("page", "col", "id", "pos", "s", "x0", (F.col("y0") + step * F.col("pos")).alias("y0"), "x1", (F.col("y0") + step * (F.col("pos") + 1)).alias("y1"))
    order, label = ["y0", "x0", "id", "pos"], _found(F.col("s"), BARE)
    x = x.select(
        "*", F.row_number().over(Window.partitionBy("page", "col").orderBy(*order)).alias("r"), F.max(F.col("x1") - F.col("x0")).over(Window.partitionBy("page", "col")).alias("widest"),
        question_number(F.col("s")).alias("number"), F.when(F.regexp_extract("s", BARE, 1) == label.cast("string"), label).alias("bare"), _found(F.col("s"), CAPTION).alias("caption"),
        F.col("s").rlike(SOLUTION).alias("solves"), F.col("s").rlike(OPTION).alias("option"), F.col("s").rlike(FIGURE_LINE).alias("figured"),
    )

    place = F.struct("col", "y0", "x0", "id", "pos", "r", "y1", "x1")
    shown = x.where("number IS NOT NULL").groupBy("page", F.col("number").alias("label")).agg(F.min(place).alias("p")).withColumn("late", F.lit(False))
    missing = wanted.select("page", "label").distinct().join(shown, ["page", "label"], "left_anti")
    bare = x.where("bare IS NOT NULL").withColumnRenamed("bare", "label").join(missing, ["page", "label"]).groupBy("page", "label").agg(F.min(place).alias("p")).withColumn("late", F.lit(True))
    a = shown.unionByName(bare).select("page", "label", "late", *(F.col(f"p.{c}").alias(f"a_{c}") for c in ("col", "y0", "r", "x0", "x1", "y1")))

    # slots: the heights at which questions begin in a column, with the one before and the one after
    col = Window.partitionBy("page", "a_col").orderBy("a_y0")
    slots = a.select("page", "a_col", "a_y0").distinct().select("*", F.lead("a_y0").over(col).alias("bound"), F.lag("a_y0").over(col).alias("floor"))
    a = a.join(slots, ["page", "a_col", "a_y0"]).withColumn("bound", F.coalesce("bound", F.lit(float(height)))).withColumn("floor", F.coalesce("floor", F.lit(0.0)))

    marks = slots.select("page", F.col("a_col").alias("col"), F.col("a_y0").alias("y0"), F.col("a_y0").alias("slot"))
    within = Window.partitionBy("page", "col").orderBy("y0").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.unionByName(marks, allowMissingColumns=True).withColumn("slot", F.max("slot").over(within)).where("r IS NOT NULL AND slot IS NOT NULL")
    rows = a.join(x.withColumnRenamed("col", "a_col").withColumnRenamed("slot", "a_y0"), ["page", "a_col", "a_y0"]).where(F.col("y0") < F.col("bound"))

    own = F.col("caption").isNull() | (F.col("caption") == F.col("label"))
    printed = (F.col("x1") - F.col("x0") >= PRINT_SHARE * F.greatest("widest", F.lit(1))) | F.col("option") | F.col("figured")
    by = Window.partitionBy("page", "label").orderBy("r")
    rows = rows.withColumn("own", own).withColumn("run", F.count_if(F.col("own") & printed).over(by))
    run = Window.partitionBy("page", "label", "run")
    loose = F.col("own") & ~printed
    rows = rows.withColumn("note", F.when(F.count_if(loose).over(run) >= NOTE_LINES, F.min(F.when(loose, F.col("y0"))).over(run)))
    rows = rows.withColumn("note", F.min("note").over(Window.partitionBy("page", "label")))
    body = F.col("own") & (F.col("note").isNull() | (F.col("y0") < F.col("note")))
    head = ["late", "a_col", "a_y0", "a_r", "a_x0", "a_x1", "a_y1", "bound", "floor"]
    best = lambda f, c: F.coalesce(f(F.when(body, F.col(c))), f(F.when(F.col("own"), F.col(c))), F.first(f"a_{c}"))
    q = rows.groupBy("page", "label").agg(
        *(F.first(c).alias(c) for c in head), best(F.min, "x0").alias("x0"), best(F.max, "x1").alias("x1"), best(F.max, "y1").alias("y1"), F.min(F.when(F.col("solves") & (F.col("r") > F.col("a_r")), F.col("y0"))).alias("solution")
    )
    end = F.least("bound", F.col("y1") + F.greatest(F.lit(PAD), PAD_LINE * (F.col("a_y1") - F.col("a_y0"))))
    pad = max(PAD, PAD_PAGE * width)
    q = q.withColumn("end", end).withColumn("x0", F.col("x0") - pad).withColumn("x1", F.col("x1") + pad)

    f = figures.where("fx1 > fx0 AND fy1 > fy0").withColumn("fid", F.monotonically_increasing_id()).withColumnRenamed("label", "declared")
    overlap = F.least("fy1", "bound") - F.greatest("fy0", "a_y0")
    claims = f.join(a.select("page", "label", "late", "a_col", "a_y0", "a_r", "bound"), "page").where((F.col("declared") == F.col("label")) | (overlap > 0))
    first = F.struct(F.col("declared").eqNullSafe(F.col("label")).alias("said"), overlap.alias("overlap"), (~F.col("late")).alias("early"), (-F.col("a_col")).alias("c"), (-F.col("a_r")).alias("r"), "label")
    owned = claims.groupBy("page", "fid", "fx0", "fy0", "fx1", "fy1").agg(F.max(first)["label"].alias("label"))
    owned = owned.groupBy("page", "label").agg(F.min("fx0").alias("fx0"), F.min("fy0").alias("fy0"), F.max("fx1").alias("fx1"), F.max("fy1").alias("fy1"), F.count("*").alias("n_figures"))

    share = lambda c, most: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / most)), 6)
    z = wanted.select("page", "label").distinct().join(q, ["page", "label"], "left").join(owned, ["page", "label"], "left")
    top = F.greatest("floor", F.least("a_y0", "fy0"))
    bottom = F.least("bound", F.greatest("end", "fy1"))
    found = F.col("end").isNotNull()
    box = {"x0": share(F.least("x0", "fx0"), width), "y0": share(F.when(F.col("fy0").isNull(), F.col("a_y0")).otherwise(top), height), "x1": share(F.greatest("x1", "fx1"), width), "y1": share(bottom, height)}
    whole = {"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}
    return z.select(
        "page", "label", found.alias("located"), *(F.when(found, v).otherwise(whole[k]).alias(k) for k, v in box.items()),
        F.when(F.col("solution") < F.col("end"), share(F.col("solution"), height)).alias("solution"), F.when(found, F.coalesce("n_figures", F.lit(0))).otherwise(0).cast("long").alias("n_figures"),
    )


# Overlaps at which two boxes are the same spot, and numbers that may be the end of a cut year.
SAME_IOU, SAME_INSIDE, SAME_BAND, PLAIN_NUMBER, BAND = 0.5, 0.7, 0.6, 20, 30
NUMBER_IN_LINE = re.compile(r"(?<!\d)(\d{1,2})[.、]")


def numbers_in(s: str) -> tuple[int, ...]:
    """Question numbers in a reading; above 20 one that only a single letter follows is the rest of a year."""
    hits = ((int(m[1]), s[m.end() :]) for m in NUMBER_IN_LINE.finditer(s))
    return tuple(n for n, rest in hits if n <= PLAIN_NUMBER or not re.fullmatch("[A-Za-z]", rest))


def same_spot(a: tuple, b: tuple) -> bool:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return False
    area = [max(0, c[2] - c[0]) * max(0, c[3] - c[1]) for c in (a, b)]
    inside = w * h / min(area) > SAME_INSIDE and h / min(a[3] - a[1], b[3] - b[1]) > SAME_BAND
    return inside or w * h / (sum(area) - w * h) > SAME_IOU


def better(a: tuple[str, float], b: tuple[str, float]) -> bool:
    """Whether reading a = (text, score) replaces b: numbers, digits for equal numbers, the longer if it holds the other, the shorter, score."""
    na, nb = numbers_in(a[0]), numbers_in(b[0])
    if bool(na) != bool(nb):
        return bool(na)
    digits = [sum(c.isdigit() for c in s) for s in (a[0], b[0])]
    if na == nb and digits[0] != digits[1]:
        return digits[0] > digits[1]
    ta, tb = ("".join(s.split()) for s in (a[0], b[0]))
    if ta == tb:
        return a[1] > b[1]
    return (len(ta) > len(tb)) if ta in tb or tb in ta else len(ta) < len(tb)


def fused(readings: DataFrame, page: str) -> DataFrame:
    """page, id, place: of the readings of each spot of a page (id, x0, y0, x1, y1, score, body) the best, in bands of rows.

    Readings whose numbers differ are parts of one line, and all stay; null bodies are empty.  A page is one task's.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[tuple, str, float, int]] = []
        for r in pdf.sort_values(["score", "id"], ascending=[False, True]).itertuples():
            box, body = (r.x0, r.y0, r.x1, r.y1), r.body or ""
            same = [k for k, v in enumerate(kept) if same_spot(box, v[0])]
            mine, theirs = set(numbers_in(body)), [set(numbers_in(kept[k][1])) for k in same]
            if any(kept[k][1] == body for k in same):
                continue
            if not same or (mine and all(t and not mine & t for t in theirs)):
                kept.append((box, body, r.score, r.id))
                continue
            at = next((k for k, t in zip(same, theirs, strict=True) if mine & t), same[0])
            if better((body, r.score), kept[at][1:3]):
                kept[at] = (box, body, r.score, r.id)
        kept.sort(key=lambda v: (round((v[0][1] + v[0][3]) / 2 / BAND), v[0][0]))
        return pd.DataFrame({page: pdf[page].iloc[0], "id": [v[3] for v in kept], "place": range(len(kept))})

    return readings.select(page, "id", "x0", "y0", "x1", "y1", "score", "body").groupBy(page).applyInPandas(pick, f"{page} long, id long, place long")
