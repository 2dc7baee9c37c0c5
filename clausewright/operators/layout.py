"""Pages from their parts: lines from spans or words, running lines, footnotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

c = F.col


def layout_rows(spans: DataFrame, page: str, tolerance: float = 2.8, gap: float = 11.0) -> DataFrame:
    """page, row, said: spans (x0, x1, y, text) whose baselines follow each other within the tolerance are one row; a gap of
    more than `gap` begins a cell. Marks alone are dropped. A page is one group, as its parts are few."""
    words = spans.where(~c("text").rlike(r"^\s*[•▪◦·\-–]*\s*$"))
    down = Window.partitionBy(page).orderBy("y", "x0")
    rows = words.withColumn("_new", F.when(c("y") - F.lag("y").over(down) <= tolerance, 0).otherwise(1)).withColumn("row", F.sum("_new").over(down))
    across = Window.partitionBy(page, "row").orderBy("x0")
    glue = F.when(F.lag("x1").over(across).isNull(), "").when(c("x0") - F.lag("x1").over(across) > gap, " | ").otherwise(" ")
    parts = rows.withColumn("_said", F.concat(glue, F.trim("text")))
    joined = parts.groupBy(page, "row").agg(F.array_sort(F.collect_list(F.struct("x0", "_said"))).alias("_parts"))
    return joined.select(page, "row", F.array_join(F.transform("_parts", lambda p: p["_said"]), "").alias("said"))


def without_running_lines(pages: DataFrame, document: str, lines: str, least: int = 3, share: float = 0.3) -> DataFrame:
    """The pages without first and last lines that, digits aside, repeat on `least` pages of their document or more and on at
    least this share of them. Counts combine before the shuffle."""
    edge = lambda i: F.regexp_replace(F.element_at(lines, i), "[0-9]+", "#")
    marked = pages.withColumn("_top", edge(1)).withColumn("_bottom", edge(-1))
    total = pages.groupBy(c(document).alias("_d")).agg(F.count(F.lit(1)).alias("_pages"))

    def running(column: str) -> DataFrame:
        counts = marked.groupBy(c(document).alias("_d"), c(column).alias("_line")).agg(F.count(F.lit(1)).alias("_n"))
        return counts.where(c("_n") >= least).join(total, "_d").where(c("_n") >= share * c("_pages")).select(c("_d").alias(f"{column}_d"), c("_line").alias(f"{column}_line"))

    for column in ("_top", "_bottom"):
        seen = running(column)
        marked = marked.join(seen, (c(document) == c(f"{column}_d")) & (c(column) == c(f"{column}_line")), "left")
    first = F.when(c("_top_d").isNotNull(), 1).otherwise(0)
    last = F.when(c("_bottom_d").isNotNull() & (F.size(lines) > 1), 1).otherwise(0)
    kept = F.slice(lines, first + 1, F.greatest(F.size(lines) - first - last, F.lit(0)))
    return marked.withColumn(lines, kept).select(*pages.columns)


def footnotes(lines: DataFrame, page: str, body: float, height: float) -> DataFrame:
    """Marks footnotes: from a line in the lower half, in small type, that begins with a number, if nothing of the body's size
    follows it on the page."""
    w = Window.partitionBy(page).orderBy("y")
    after = F.max("size").over(w.rowsBetween(0, Window.unboundedFollowing))
    start = (c("size") < 0.85 * body) & (c("y") > 0.5 * height) & c("text").rlike(r"^\s*[0-9]{1,3}[).]?\s") & (after < 0.85 * body)
    return lines.withColumn("_start", F.when(start, 1).otherwise(0)).withColumn("footnote", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)) > 0).drop("_start")
