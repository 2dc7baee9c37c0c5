"""Disclosure checks: levels of a rule, figures with a quotation, completeness, discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import chain, compare
from ..functions.text import normal_key

c = F.col
SALTS = 64
# What missing a level of a rule means.
LEVELS = {"minimum": "BREACH", "buffer": "BUFFER_SHORTFALL", "target": "TARGET_SHORTFALL"}


def evaluate_level(value: Column, operator: Column, threshold: Column, level: Column) -> Column:
    """PASS, or what falling short at this level means."""
    short = chain([(level == name, F.lit(status)) for name, status in LEVELS.items()], F.lit("BREACH"))
    return F.when(compare(value, operator, threshold), "PASS").otherwise(short)


def disclosed_status(value: Column, verified: Column, confidence: Column, status: Column) -> Column:
    """An unverified rule needs review, an absent figure is not disclosed, a shaky breach needs review too."""
    return chain([(~verified, F.lit("NEEDS_REVIEW")), (value.isNull(), F.lit("NOT_DISCLOSED")), ((status != "PASS") & (confidence == "low"), F.lit("NEEDS_REVIEW"))], status)


def completeness(rows: DataFrame, items: DataFrame, key: str, text: str) -> DataFrame:
    """Each item with the first row (least key) that matches its pattern: PRESENT or LIKELY_MISSING.

    items: item, pattern; a short list, sent to every partition; rows combine to one minimum for each item.
    """
    hits = rows.join(F.broadcast(items), F.expr(f"{text} rlike pattern")).groupBy("item").agg(F.min(key).alias("first"))
    return items.select("item").join(hits, "item", "left").withColumn("status", F.when(c("first").isNotNull(), "PRESENT").otherwise("LIKELY_MISSING"))


def discover_rules(rules: DataFrame, term: str, k: int = 3) -> DataFrame:
    """The k best rules for a term: 3 points for its variable, 1 for its other wording, 1 for a requirement."""
    points = F.when(F.lower("variable_text").contains(term), 3).otherwise(0) + F.when(F.lower("brand").contains(term), 1).otherwise(0)
    scored = rules.withColumn("score", points).where("score > 0").withColumn("score", c("score") + F.when(c("atom_kind") == "requirement", 1).otherwise(0))
    best = scored.groupBy("clause_id", "operator", "threshold").agg(F.max_by(F.struct("rule_id", "score"), F.struct("score", -c("rule_id"))).alias("b"))
    return best.select("b.rule_id", "b.score").orderBy(c("score").desc(), "rule_id").limit(k)


def match_by_name(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose names are equal once case and signs are gone."""
    return left.withColumn("_k", normal_key(c(a), "")).join(right.withColumn("_k", normal_key(c(b), "")), "_k").drop("_k")


def quoted(document: Column, quote: Column, figure: Column) -> Column:
    """A figure counts if its quotation is in the document, blanks aside, and the figure in the quotation."""
    squash = lambda x: F.lower(F.regexp_replace(x, r"\s+", ""))
    return squash(document).contains(squash(quote)) & quote.contains(figure)


def tier_threshold(size: Column, tiers: list[tuple[float, float]], above: float) -> Column:
    """The threshold of the first tier whose upper bound a size is below."""
    return chain([(size < bound, F.lit(threshold)) for bound, threshold in tiers], F.lit(above))


def glide_threshold(step: Column, path: list[tuple[int, float]], after: float) -> Column:
    """The threshold that a glide path allows at its steps; after them the whole one holds."""
    return chain([(step == at, F.lit(threshold)) for at, threshold in path], F.lit(after))


def tiered_status(value: Column, threshold: Column, glide: Column) -> Column:
    """PASS, ON_GLIDE_PATH where only the path's threshold is met, else BREACH."""
    return chain([(value >= threshold, F.lit("PASS")), (value >= glide, F.lit("ON_GLIDE_PATH"))], F.lit("BREACH"))


def best_candidates(candidates: DataFrame, keys: list[str], value: str, score: str, place: str) -> DataFrame:
    """The best candidate of each key (the highest score, then the first place) with how many agree with it and up to four
    other values, the best of them first.

    Values are combined before the shuffle, and each of SALTS parts of a key keeps its five best, so that no task orders all
    values of a frequent key.
    """
    order = F.struct((-c(score)).alias("s"), c(place).alias("p"), c(value).alias("v"))
    values = candidates.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("agree"), F.min(order).alias("o"))
    salted = values.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)))
    few = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy("o"))).where("_r <= 5")
    best = few.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("o"))).where("_r <= 5")
    held = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", value, "agree"))).alias("b"))
    return held.select(*keys, c("b")[0][value].alias(value), c("b")[0]["agree"].alias("agree"), F.transform(F.slice("b", 2, 4), lambda x: x[value]).alias("alternatives"))


def schedules(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, since, value of a schedule written as "v1 per cent from d1, v2 per cent from d2, ..."."""
    pattern = r"([0-9]+(?:\.[0-9]+)?) per cent from ([0-9]{4}-[0-9]{2}-[0-9]{2})"
    values, dates = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    pairs = rows.select(key, values.alias("v"), dates.alias("d")).select(key, F.explode(F.arrays_zip("v", "d")).alias("z"))
    return pairs.select(key, c("z.d").cast("date").alias("since"), c("z.v").cast("double").alias("value"))


#: A report's counts: name, family of results, statuses that count (none: all).
REPORT_COUNTS = (
    ("rules_checked", "rule", ()),
    ("rules_passed", "rule", ("PASS", "PASS_WITH_CONDITIONS")),
    ("breaches", "rule", ("BREACH",)),
    ("buffer_shortfalls", "rule", ("BUFFER_SHORTFALL",)),
    ("target_shortfalls", "rule", ("TARGET_SHORTFALL",)),
    ("not_disclosed", "rule", ("NOT_DISCLOSED", "NOT_REPORTED")),
    ("candidates", "rule", ("CANDIDATE",)),
    ("items_checked", "disclosure", ()),
    ("items_present", "disclosure", ("PRESENT",)),
    ("items_missing", "disclosure", ("LIKELY_MISSING",)),
    ("obligations_matched", "qualitative", ()),
    ("obligations_covered", "qualitative", ("COVERED",)),
    ("obligations_partial", "qualitative", ("PARTIAL",)),
    ("network_checked", "network", ()),
    ("network_breaches", "network", ("BREACH", "PROHIBITED")),
    ("network_attention", "network", ("POTENTIAL_BREACH", "NEEDS_REVIEW", "ASSESSMENT_REQUIRED")),
)


def report_summary(results: DataFrame, key: str) -> DataFrame:
    """The counts of a report (REPORT_COUNTS), what needs review, and the verdict: BREACH, ATTENTION, PASS where any rule had a
    figure, else INSUFFICIENT_DATA. results: key, family, status; all in one aggregation."""
    counted = [F.count_if((c("family") == family) & (c("status").isin(*statuses) if statuses else F.lit(True))).alias(name) for name, family, statuses in REPORT_COUNTS]
    review = F.count_if(c("family").isin("rule", "qualitative") & (c("status") == "NEEDS_REVIEW")).alias("needs_review")
    sums = results.groupBy(key).agg(*counted, review)
    some = lambda *names: sum((c(n) for n in names), F.lit(0)) > 0
    attention = some("buffer_shortfalls", "target_shortfalls", "needs_review", "items_missing", "network_attention")
    figures = c("rules_checked") - c("not_disclosed") - c("candidates") > 0
    verdict = chain([(some("breaches", "network_breaches"), F.lit("BREACH")), (attention, F.lit("ATTENTION")), (figures, F.lit("PASS"))], F.lit("INSUFFICIENT_DATA"))
    return sums.withColumn("overall", verdict)
