"""Stream-shaped ingestion: each function drains what has arrived and ends (availableNow)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.rules import latest


def arrivals(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def detect_changes(stream: DataFrame, state: str, changes: str, checkpoint: str, key: str, label: str) -> None:
    """Emit rows whose label is new or differs from the last one seen for their key.

    The state is a table of versions, one per batch; a batch that is replayed writes the same version again.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        fresh = latest(rows, [key], [F.col("seen_at").desc(), F.col(label)]).select(key, label, "seen_at")
        known = _versions(spark, state, number, fresh.schema)
        last = latest(known, [key], [F.col("_version").desc()]).select(key, F.col(label).alias("_last"))
        changed = fresh.join(last, key, "left").where(~F.col(label).eqNullSafe(F.col("_last"))).drop("_last")
        changed.write.mode("overwrite").parquet(f"{changes}/batch={number}")
        changed.write.mode("overwrite").parquet(f"{state}/_version={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _versions(spark: SparkSession, state: str, before: int, schema: StructType) -> DataFrame:
    """The state's versions before a batch; an empty table at first."""
    empty = spark.createDataFrame([], schema).withColumn("_version", F.lit(0))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return empty
    return spark.read.schema(empty.schema).parquet(state).where(F.col("_version") < before)


def ingest_once(stream: DataFrame, target: str, checkpoint: str, content: str) -> None:
    """Rows whose content has not been ingested before, by its hash, also across runs."""
    hashed = stream.withColumn("sha256", F.sha2(content, 256)).dropDuplicates(["sha256"])
    hashed.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def backfill(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still missing from a derived table."""
    return source.join(done.select(key), key, "left_anti")


def windowed_counts(stream: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Our extension: counts by event-time window with a bound on lateness."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n"))


def check_only(stream: DataFrame, state: str, key: str, label: str, checkpoint: str) -> list[tuple]:
    """A scheduled look: what has arrived and differs from the last label seen, without taking it in. The checkpoint is the
    look's own, and the state stays as it is; the list is as long as the watch list."""
    found: list[tuple] = []

    def batch(rows: DataFrame, _: int) -> None:
        fresh = latest(rows, [key], [F.col("seen_at").desc(), F.col(label)]).select(key, label)
        known = _versions(rows.sparkSession, state, 1 << 62, rows.select(key, label, "seen_at").schema)
        last = latest(known, [key], [F.col("_version").desc()]).select(key, F.col(label).alias("_last"))
        found.extend(tuple(r) for r in fresh.join(last, key, "left").where(~F.col(label).eqNullSafe(F.col("_last"))).drop("_last").collect())

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return found


def ingest_documents(stream: DataFrame, target: str, checkpoint: str, key: str, text: str) -> None:
    """Takes new documents in one by one: each batch writes its clauses and the references found in them, as a partition that
    a replay replaces."""
    from ..functions.text import cross_references

    def batch(rows: DataFrame, number: int) -> None:
        clauses = rows.select(key, F.posexplode(F.split(text, r"\n+")).alias("seq", "clause")).where("trim(clause) <> ''")
        clauses.write.mode("overwrite").parquet(f"{target}/clauses/batch={number}")
        found = clauses.select(key, "seq", F.explode(cross_references(F.col("clause"))).alias("r")).select(key, "seq", "r.kind", "r.target")
        found.write.mode("overwrite").parquet(f"{target}/references/batch={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
