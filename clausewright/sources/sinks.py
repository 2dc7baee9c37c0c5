"""Sinks: appends, keyed upserts, build-then-switch publication, additive schemas."""

from __future__ import annotations

import html
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import latest


def append_run(df: DataFrame, path: str, run_id: str) -> None:
    """Rows of one run, as a partition of their own: writing it again replaces that run alone."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """old with new rows in place of those of the same key; columns that only one side has are null on the other."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [F.col("_new").desc(), *(order or [])]).drop("_new")


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key the old table lacks, one for each key."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def publish(df: DataFrame, base: str) -> str:
    """Write a new version beside the old ones, then point to it; readers never see half a table. The pointer is a file
    that a rename puts in place of the old one at once."""
    spark = df.sparkSession
    base = base.rstrip("/")
    version = f"{base}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
    fresh = path(f"_pointer-{uuid.uuid4().hex}")
    out = fresh.getFileSystem(conf).create(fresh)
    out.write(bytearray(version.encode()))
    out.close()
    replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), conf).rename(fresh, path("current"), replace)
    return version


def read_published(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(spark.read.text(f"{base.rstrip('/')}/current").first()[0])


def write_csv(df: DataFrame, path: str) -> None:
    """A table as quoted CSV with a header, as a spreadsheet reads it."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_html(df: DataFrame, path: str, title: str, order: list[str]) -> None:
    """A report as one page of HTML that needs no other file: a table of the rows, in order. A page is for a bounded report."""
    safe = lambda x: F.replace(F.replace(F.replace(F.coalesce(x.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), safe(F.col(f"`{n}`")), F.lit("</td>")) for n in df.columns], F.lit("</tr>"))
    rows = df.select(F.struct(*order, cells.alias("cells")).alias("row")).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    names = "".join(f"<th>{html.escape(n)}</th>" for n in df.columns)
    top = f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table>\n<tr>{names}</tr>\n'
    page = F.concat(F.lit(top), F.array_join(F.transform("rows", lambda r: r["cells"]), "\n"), F.lit("\n</table></body></html>"))
    rows.select(page.alias("value")).write.mode("overwrite").text(path)


def import_bundle(entities: DataFrame, edges: DataFrame, known_types: tuple[str, ...], base: str) -> DataFrame:
    """All or nothing: publishes both tables under a folder if no row has an error; returns the errors (row, message)."""
    entity = F.col("entity_id")
    problems = entities.select(entity.cast("string").alias("row"), F.when(entity.isNull(), "entity without an id").when(~F.col("entity_type").isin(*known_types), "unknown entity type").alias("message"))
    double = entities.groupBy("entity_id").count().where("count > 1").select(entity.cast("string").alias("row"), F.lit("entity id used twice").alias("message"))
    ends = edges.select(F.explode(F.array("from_entity", "to_entity")).alias("entity_id")).join(entities, "entity_id", "left_anti")
    loose = ends.select(entity.cast("string").alias("row"), F.lit("edge to an entity that is not there").alias("message")).distinct()
    own = edges.where("from_entity = to_entity").select(F.col("from_entity").cast("string").alias("row"), F.lit("edge to itself").alias("message"))
    errors = problems.where("message IS NOT NULL").union(double).union(loose).union(own)
    if errors.isEmpty():
        publish(entities, f"{base}/entities")
        publish(edges, f"{base}/edges")
    return errors
