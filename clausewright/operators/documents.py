"""Documents on their way in: formats, figures in lines, rules anchored in texts, batches, carried columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import chain
from ..functions.wording import numbers_in

c = F.col
# File extensions and the formats that they mean.
FORMATS = {"pdf": "pdf", "xlsx": "xlsx", "xlsm": "xlsx", "csv": "csv", "tsv": "csv", "txt": "txt", "md": "txt", "html": "html", "htm": "html", "json": "json"}
# Amounts in crore of one unit.
TO_CRORE = {"lakh crore": 100_000.0, "crore": 1.0, "lakh": 0.01, "million": 0.1, "billion": 100.0}


def file_format(name: Column) -> Column:
    """The format that a file's extension means; null for one that is not read."""
    extension = F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
    return chain([(extension == e, F.lit(f)) for e, f in FORMATS.items()], F.lit(None).cast("string"))


def admission(name: Column, scanned: Column, text: Column, least: int = 20) -> Column:
    """200, or why a file is turned away: 415 for its format, 422 for a scan or too little text."""
    return chain([(file_format(name).isNull(), F.lit(415)), ((file_format(name) == "pdf") & scanned, F.lit(422)), (F.length(F.trim(F.coalesce(text, F.lit("")))) < least, F.lit(422))], F.lit(200))


def amount_factor(text: Column) -> Column:
    """Crore in one unit of the amounts that a line states; 1 where it names no unit."""
    return chain([(text.rlike(rf"(?i)\b{u}s?\b"), F.lit(x)) for u, x in TO_CRORE.items()], F.lit(1.0))


def figures(lines: DataFrame, metrics: DataFrame) -> DataFrame:
    """Candidates for each metric: the first acceptable number behind its label, a line each.

    metrics: metric, label and exclude (patterns), unit, low, high: a short catalog, sent to every partition. A percentage is
    one only with a sign; an amount is turned into crore; numbers out of range do not count. A label at the line's start, a
    cell separator and a statement of the amount each add to the score.
    """
    hits = lines.join(F.broadcast(metrics), F.expr("text rlike concat('(?i)', label) AND NOT text rlike concat('(?i)', exclude)"))
    rest = F.expr("substring(text, regexp_instr(text, concat('(?i)', label)))")
    wanted = F.filter(numbers_in(rest), lambda x: F.when(c("unit") == "%", x["percent"]).otherwise(~x["percent"]))
    scaled = F.transform(wanted, lambda x: x["value"] * F.when(c("unit") == "%", 1.0).otherwise(amount_factor(c("text"))))
    fit = F.filter(scaled, lambda v: v.between(c("low"), c("high")))
    score = F.when(F.expr("text rlike concat('(?i)^', label)"), 2).otherwise(0) + F.when(c("text").contains("|") | c("text").contains(":"), 2).otherwise(0) + F.when(c("text").rlike(r"(?i)\b(?:stood at|was|is|rose to)\b"), 1).otherwise(0)
    return hits.select("metric", "page", "line", F.get(fit, F.lit(0)).alias("value"), "unit", score.alias("score")).where("value IS NOT NULL")


def best_figures(candidates: DataFrame) -> DataFrame:
    """The best candidate of each metric: the highest score, then the first in the document."""
    first = F.struct(-c("score"), c("page"), c("line"), c("value"))
    best = candidates.groupBy("metric").agg(F.min_by(F.struct("value", "unit", "page", "line", "score"), first).alias("b"))
    return best.select("metric", "b.*")


def aliased(rows: DataFrame, metrics: DataFrame, name: str) -> DataFrame:
    """Each named value's metric: by key, by alias, then by label; the first of these that fits."""
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c(name)), r"[^a-z0-9]+", " "), r"\bin\b.*$", ""))
    kind = F.when(c("_key") == F.replace("metric", F.lit("_"), F.lit(" ")), 0).when(c("_key") == c("alias"), 1).when(F.expr(f"{name} rlike concat('(?i)', label) AND NOT {name} rlike concat('(?i)', exclude)"), 2)
    found = rows.withColumn("_key", key).join(F.broadcast(metrics), F.lit(True), "left").withColumn("_kind", kind)
    best = F.min_by(F.when(c("_kind").isNotNull(), c("metric")), F.struct(F.coalesce("_kind", F.lit(9)), "metric"))
    return found.groupBy(*rows.columns).agg(best.alias("metric"))


def anchored(clauses: DataFrame, rules: DataFrame, document: str, order: list[str], text: str) -> DataFrame:
    """Each rule with the first clause whose document and text match its patterns; rules without one stay, unverified.

    rules: rule, document_pattern, text_pattern: a short catalog, sent to every partition; a rule's clauses combine to one
    minimum before they are shuffled.
    """
    fits = F.expr(f"{document} rlike document_pattern AND {text} rlike concat('(?i)', text_pattern)")
    hits = clauses.join(F.broadcast(rules), fits).groupBy("rule").agg(F.min(F.struct(c(document).alias("document"), *order)).alias("first"))
    found = rules.select("rule").join(hits, "rule", "left")
    return found.select("rule", c("first").isNotNull().alias("verified"), "first.*")


def length_batches(rows: DataFrame, length: Column, key: str, size: int = 32) -> DataFrame:
    """The rows with a batch number: the longest first, `size` a batch. Lengths are counted first, so that no task orders
    more than the rows of one length."""
    sized = rows.withColumn("_n", length)
    counts = sized.groupBy("_n").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy(c("_n").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_n").orderBy(key)) - 1 + c("_before")
    numbered = sized.join(counts.select("_n", before.alias("_before")), "_n").withColumn("batch", F.floor(place / size).cast("long"))
    return numbered.drop("_n", "_before")


def carried_columns(old: DataFrame, new: DataFrame) -> list[str]:
    """The columns that both tables have, in the new one's order: what a rebuild carries over."""
    return [name for name in new.columns if name in set(old.columns)]


def require_version(meta: DataFrame, least: float = 2.0) -> float:
    """The extraction version that a corpus says it has; too old or missing is an error."""
    found = meta.where("key = 'extraction_version'").select("value").first()
    version = float(found["value"]) if found and found["value"] else 0.0
    if version < least:
        raise ValueError(f"the corpus was built by extraction version {version}, at least {least} is needed: build it anew")
    return version


def numbered_scopes(rows: DataFrame, key: str, order: list[str], number: str, most: int = 6) -> DataFrame:
    """Runs of a numbering: a number that does not follow the one before by 1 to `most` begins a new scope."""
    w = Window.partitionBy(key).orderBy(*order)
    step = c(number) - F.lag(number).over(w)
    return rows.withColumn("_new", F.when(step.between(1, most), 0).otherwise(1)).withColumn("scope", F.sum("_new").over(w)).drop("_new")
