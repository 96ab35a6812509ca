"""Connected components and trees."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints to the folder in spark.checkpoint.dir; a local session without one gets a folder of its own, a cluster is refused."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        there = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not there and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(there or tempfile.mkdtemp(prefix="scholia-"))
    return df.checkpoint()


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """node, comp: the smallest node reachable over any number of pairs; labels jump to their label's label."""
    ways = cut(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(pairs.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct())
    label = cut(ways.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("comp")))
    while True:
        near = ways.join(label.toDF("v", "c"), "v").groupBy(F.col("u").alias("node")).agg(F.min("c").alias("c"))
        low = label.join(near, "node").select("node", "comp", F.least("comp", "c").alias("c"))
        new = cut(low.join(label.toDF("c", "cc"), "c", "left").select("node", F.least("c", "cc").alias("comp"), (F.least("c", "cc") < F.col("comp")).alias("moved")))
        label = new.select("node", "comp")
        if new.where("moved").limit(1).count() == 0:
            return label


def closure(nodes: DataFrame, key: str, parent: str, deepest: int = 32, starts: DataFrame | None = None) -> DataFrame:
    """node, ancestor, depth: every ancestor of every node with its distance (0: itself), to at most ``deepest`` levels; starts (key): of these nodes only.

    Ways of 1, 2, 4 and so on levels are joined to what is known, so a tree of n levels takes log n joins and no table is
    moved more often than that; files of few bytes may hold many nodes, so none of these tables is sent to all tasks.  A node of several rows or parents has a row for each way up.
    """
    way = cut(nodes.select(F.col(key).alias("u"), F.col(parent).alias("v")).where("u IS NOT NULL AND v IS NOT NULL"))
    first = nodes if starts is None else nodes.join(starts.select(key).distinct().hint("merge"), key, "left_semi")
    up = first.select(F.col(key).alias("node"), F.col(key).alias("ancestor"), F.lit(0).alias("depth"))
    length = 1
    while length <= deepest and not way.isEmpty():
        farther = up.where(F.col("depth") <= deepest - length).join(way.hint("merge"), F.col("ancestor") == F.col("u")).select("node", F.col("v").alias("ancestor"), (F.col("depth") + length).alias("depth"))
        way = cut(way.join(way.toDF("v", "w").hint("merge"), "v").select("u", F.col("w").alias("v")))
        length *= 2
        up = up.unionByName(farther if length > deepest or way.isEmpty() else cut(farther))
    return up


def moves(nodes: DataFrame, asked: DataFrame, key: str, parent: str, deepest: int = 32) -> DataFrame:
    """asked (key, target) with the reason why a move is refused, or empty: self, cycle (the target is below it), missing, too_deep.

    The way up from the target is looked at in order, so what comes first on it decides.
    """
    up = closure(nodes, key, parent, deepest, asked.select(F.col("target").alias(key)))
    known = nodes.select(F.col(key).alias("ancestor"), F.lit(True).alias("known"), F.col(parent).alias("next"))
    way = up.join(known.hint("merge"), "ancestor", "left").groupBy(F.col("node").alias("target")).agg(F.min(F.when(F.col("known").isNull(), F.col("depth"))).alias("lost"), F.max("depth").alias("depth"), F.max(F.when(F.col("next").isNull(), F.col("depth"))).alias("root"))
    met = asked.hint("merge").join(up.select(F.col("node").alias("target"), F.col("ancestor").alias(key), F.col("depth").alias("at")), ["target", key], "left")
    x = met.join(way.hint("merge"), "target", "left")
    cycle = F.col("at").isNotNull() & (F.col("lost").isNull() | (F.col("at") < F.col("lost")))
    return x.select(key, "target", F.when(F.col("target") == F.col(key), "self").when(F.col("target").isNull(), "").when(F.col("depth").isNull(), "missing").when(cycle, "cycle").when(F.col("lost").isNotNull(), "missing").when(F.col("root").isNull(), "too_deep").otherwise("").alias("reason"))


def lifted(nodes: DataFrame, gone: DataFrame, key: str, parent: str) -> DataFrame:
    """Nodes that stay, each with its nearest ancestor that stays as its parent (null: none); gone: key of deleted ones."""
    marked = nodes.join(gone.select(key, F.lit(True).alias("gone")).hint("merge"), key, "left")
    stay = marked.where("gone is null").select(F.col(key).alias("ancestor"))
    up = closure(nodes, key, parent, starts=stay.toDF(key)).where("depth > 0").join(stay.hint("merge"), "ancestor")
    nearest = up.groupBy(F.col("node").alias(key)).agg(F.min_by("ancestor", "depth").alias("new_parent"))
    return marked.where("gone is null").select(key).join(nearest.hint("merge"), key, "left").select(key, F.col("new_parent").alias(parent))


def crawl(nodes: DataFrame, known: DataFrame, roots: DataFrame) -> DataFrame:
    """id, depth, state (listed, skipped, file) of all that a crawl meets, level by level from the roots (id).

    nodes: id, parent, is_dir, mtime, as they are now; known: id, mtime, as they were.  A directory whose time is the known one
    is skipped with all below it; roots are always listed.  The known times are joined to the nodes once, before the first level;
    each level is one join of its directories with what they hold, and written, so a level that is lost is done again alone.
    No table is sent to all tasks: files of few bytes may hold many nodes.  What was met before isn't met again, so circles end; null
    times are changed; ids met in one level by several parents count once; without roots nothing is met.
    """
    old = known.select("id", F.col("mtime").alias("was")).where("was IS NOT NULL").groupBy("id").agg(F.collect_set("was").alias("was"))
    child = nodes.where("id IS NOT NULL AND parent IS NOT NULL").select("id", "parent", "is_dir", "mtime")
    child = cut(child.hint("merge").join(old, "id", "left"))
    level = cut(roots.select("id").distinct().withColumn("depth", F.lit(0)).withColumn("state", F.lit("listed")))
    met = level
    depth = 0
    while True:
        depth += 1
        found = child.hint("merge").join(level.where("state = 'listed'").select(F.col("id").alias("parent")), "parent").groupBy("id").agg(F.max("is_dir").alias("is_dir"), F.max("mtime").alias("mtime"), F.first("was").alias("was"))
        found = found.join(met.select("id").hint("merge"), "id", "left_anti")
        same = F.coalesce(F.array_contains("was", F.col("mtime")), F.lit(False))
        state = F.when(~F.coalesce("is_dir", F.lit(False)), "file").when(same, "skipped").otherwise("listed")
        level = cut(found.select("id", F.lit(depth).alias("depth"), state.alias("state")))
        if level.isEmpty():
            return met
        met = met.unionByName(level)
