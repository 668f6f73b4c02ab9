"""Proportional stratified interleaving into shards of equal counts.

Rows of each source are shuffled by a seeded digest and ranked; row k of n
gets the fractional rank (k + u) / n, u being a seeded fraction of its source.
All rows are sorted by it and the sequence is cut into equal parts, so each
shard has every source's share, to within a row.

Both rankings are two-level: rows are counted per bucket of the sort key, the counts
are summed up in order, and only inside a bucket are rows sorted.
A bucket holds a few thousand rows however large its source is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import picked

ROWS_PER_BUCKET = 20_000
_2_32 = 4294967296


def _seeded(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _fraction(digest: Column) -> Column:
    """The first 32 bits of a hexadecimal digest as a number from 0 to 1."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(_2_32))


def _ranked(rows: DataFrame, group: list[str], bucket: Column, order: list[str], rank: str, total: str) -> DataFrame:
    """Rank from 0 of each row in its group, by a bucket that follows `order`,
    and the group's rows in all. Keys hold no nulls."""
    keys = [*group, "__bucket"]
    rows = rows.withColumn("__bucket", bucket)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(whole).alias(total))
    inside = Window.partitionBy(*keys).orderBy(*order)
    joined = rows.join(starts, keys)
    return joined.withColumn(rank, F.col("__start") + F.row_number().over(inside) - 1).drop("__start", "__bucket")


def stratified_shards(df: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Shards are contiguous and their counts differ by one at most. A null text is
    empty (size 1), a null source is a source of its own, a null id sorts
    first; repeated rows get a slot each; other columns are ignored; an
    empty table gives an empty result. With fewer rows than shards some shards are empty.
    """
    text = F.coalesce("text", F.lit(""))
    rows = picked(df, doc_id=(id_col, "long"), text=(text_col, "string"), source=(source_col, "string")).select(
        "doc_id",
        F.coalesce("source", F.lit("\0null")).alias("__source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("__digest", _seeded(seed, F.col("doc_id")))
    total = rows.count()
    buckets = max(128, -(-total // ROWS_PER_BUCKET))
    order = ["__digest", "doc_id", "text_crc32", "size"]
    ranked = _ranked(rows, ["__source"], F.floor(_fraction(F.col("__digest")) * buckets), order, "__rank", "__of")
    own = _fraction(_seeded(seed, F.lit("source"), F.col("__source")))
    placed = ranked.withColumn("__at", (F.col("__rank") + own) / F.col("__of")).withColumn("__all", F.lit(0))
    steps = max(1024, buckets)
    final = _ranked(placed, ["__all"], F.floor(F.col("__at") * steps), ["__at", "__source", *order], "__position", "__total")
    shard = f"((__position * {shards}) div __total)"
    start = f"(({shard} * __total + {shards - 1}) div {shards})"
    return final.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.expr(shard).cast("int").alias("shard"),
        (F.col("__position") - F.expr(start)).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
