"""Sharding by jump consistent hashing, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, pick

SHARDS = 24
#: Rows that one slot-numbering group holds on average.
GROUP_ROWS = 4096
OVERHEAD = 8


def _jump(key: Column, at: Column) -> Column:
    """The bucket that the key jumps to from bucket `at`: a draw that depends on the two alone."""
    draw = F.shiftrightunsigned(F.xxhash64(key, at.cast("int")), 33)
    return F.floor((at + 1).cast("double") * F.lit(float(1 << 31)) / (draw + 1).cast("double"))


def jump_shard(key: Column, shards: int) -> Column:
    """Jump consistent hash of the key. Its chain of buckets only grows, so `shards` steps suffice."""
    steps = F.sequence(F.lit(1), F.lit(max(1, shards - 1)))
    step = lambda at, _: F.when(_jump(key, at) < shards, _jump(key, at)).otherwise(at)
    return F.aggregate(steps, F.lit(0).cast("long"), step).cast("int")


def assign_shards(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A shard and a place in it for every row: key, size, text_crc32, law, shard, slot, grown_shard.

    The key and the shard count decide the shard (law `key`); no ring table is kept. One more shard takes
    about 1/(shards + 1) of the rows and none moves between the old ones: grown_shard tells where each
    row goes then. size is the text's UTF-8 bytes plus 8. Slots are numbered without ever bringing a
    shard into one task: rows are ranked in (shard, bucket) groups, and a small table of counts gives
    each group its first slot.

    A null text has size 8 and a null text_crc32; an empty one size 8 and crc32 0. A null key hashes
    like any value, so all such rows share a shard. Rows that repeat go to the same shard, each with a
    slot of its own. An empty table gives an empty result. Other columns are ignored.
    """
    rows = pick(docs, **{"doc_id": key, "text": text}).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        jump_shard(F.col("doc_id"), shards).alias("shard"),
    )
    # Written once, so that a row has the same number each time it is read; rows that are equal throughout differ by it.
    rows = materialize(rows, "shards")
    groups = max(64, -(-rows.count() // (shards * GROUP_ROWS)))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("row"))
    placed = rows.withColumn("rank", rank).join(firsts, ["shard", "bucket"])
    grown = F.when(_jump(F.col("doc_id"), F.col("shard")) == shards, F.lit(shards)).otherwise(F.col("shard"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"),
        grown.cast("int").alias("grown_shard"),
    )
