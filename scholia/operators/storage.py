"""Storage tiers, usage and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Days until a tier moves, price in yuan a GB and month, and ratios of the colder classes.
DISPLAY_DAYS, DOC_DAYS, ORIGINAL_DAYS, ARCHIVE_DAYS, TEMP_DAYS = 90, 90, 30, 180, 1
PRICE, INFREQUENT, ARCHIVE = 0.118, 0.45, 0.17
GB = 1 << 30


def tier_report(blobs: DataFrame) -> DataFrame:
    """blobs: kind, size_bytes, original_bytes, thumb_bytes, age (days; null is the coldest).  One row a tier."""
    kind, age = F.coalesce("kind", F.lit("image")), F.coalesce("age", F.lit(1 << 30))
    image = ~kind.isin("temp", "doc")
    row = lambda name, size, cold, archived: F.struct(F.lit(name).alias("tier"), F.coalesce(size, F.lit(0)).alias("bytes"), cold.alias("cold"), archived.alias("archived"))
    no = F.lit(False)
    tiers = F.array(
        F.when(kind == "temp", row("temp", F.col("size_bytes"), age >= TEMP_DAYS, no)),
        F.when(kind == "doc", row("doc", F.col("size_bytes"), age >= DOC_DAYS, no)),
        F.when(image, row("display", F.col("size_bytes"), age >= DISPLAY_DAYS, no)),
        F.when(image & (F.col("original_bytes") > 0), row("original", F.col("original_bytes"), age >= ORIGINAL_DAYS, age >= ARCHIVE_DAYS)),
        F.when(image & (F.col("thumb_bytes") > 0), row("thumb", F.col("thumb_bytes"), no, no)),
    )
    x = blobs.select(F.inline(F.array_compact(tiers)))
    return x.groupBy("tier").agg(
        F.count("*").alias("objects"), F.sum("bytes").alias("bytes"), F.count_if("cold").alias("cold_objects"), F.coalesce(F.sum(F.when(F.col("cold"), F.col("bytes"))), F.lit(0)).alias("cold_bytes"),
        F.coalesce(F.sum(F.when(F.col("archived"), F.col("bytes"))), F.lit(0)).alias("archived_bytes"),
    )


def tier_cost(report: DataFrame) -> DataFrame:
    """Monthly cost now (all standard, temporary objects left out) and by tiers."""
    live = F.col("tier") != "temp"
    hot = F.col("bytes") - F.col("cold_bytes") * (1 - INFREQUENT) - F.col("archived_bytes") * (INFREQUENT - ARCHIVE)
    yuan = lambda c: F.sum(F.when(live, c)) / GB * PRICE
    c = report.agg(yuan(F.col("bytes")).alias("now"), yuan(hot).alias("after"))
    return c.select(F.round("now", 4).alias("monthly_now"), F.round("after", 4).alias("monthly_after"), F.round((1 - F.col("after") / F.col("now")) * 100, 2).alias("saved_pct"))


def usage(items: DataFrame, blobs: DataFrame) -> DataFrame:
    """items: user_id, hash, own_bytes; blobs: hash, size_bytes, thumb_bytes.  A user's blobs count once however often used."""
    own = items.groupBy("user_id").agg(F.count("*").alias("used_count"), F.coalesce(F.sum(F.when(F.col("hash").isNull(), F.col("own_bytes"))), F.lit(0)).alias("own"))
    held = items.where("hash is not null").select("user_id", "hash").distinct().join(blobs, "hash").groupBy("user_id").agg(F.sum(F.col("size_bytes") + F.col("thumb_bytes")).alias("held"))
    return own.join(held, "user_id", "left").select("user_id", "used_count", (F.col("own") + F.coalesce("held", F.lit(0))).alias("used_bytes"))


def decide(used_bytes: Column, used_count: Column, tier: Column, incoming: Column, limits: dict[str, tuple[int, int]]) -> tuple[Column, Column]:
    """QUOTA_BYTES before QUOTA_COUNT, else empty; and the used share in percent, 0 to 100."""
    pick = lambda k: F.element_at(F.create_map(*(F.lit(x) for name, v in limits.items() for x in (name, v[k]))), tier)
    size, count = pick(0), pick(1)
    code = F.when(used_bytes + incoming > size, "QUOTA_BYTES").when(used_count + 1 > count, "QUOTA_COUNT").otherwise("")
    return code, F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 * used_bytes / size))
