"""The quantitative rule engine: rule atoms against reported values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import chain, compare, decision


def check_rules(rules: DataFrame, submissions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Requirements with their reported value: NOT_REPORTED, PASS or BREACH, and the decision that follows.

    rules: rule_id, operator, threshold, atom_kind; submissions: rule_id, value and any keys (bank, period).
    Conditions are not checked; an operator that is not known is a breach, not a gap.
    """
    required = rules.where("atom_kind = 'requirement'")
    reported = submissions.select("rule_id", "value", *(keys or []))
    status = chain(
        [(F.col("value").isNull(), F.lit("NOT_REPORTED")), (compare(F.col("value"), F.col("operator"), F.col("threshold")), F.lit("PASS"))],
        F.lit("BREACH"),
    )
    return required.join(reported, "rule_id", "left").withColumn("status", status).withColumn("decision", decision(F.col("status")))


def overall_verdict(checked: DataFrame, key: str, unusual: Column) -> DataFrame:
    """BREACH if any rule is breached, ATTENTION if anything is unusual, PASS if anything passed, else INSUFFICIENT_DATA."""
    any_of = lambda x: F.coalesce(F.bool_or(x), F.lit(False))
    verdict = chain([(any_of(F.col("status") == "BREACH"), F.lit("BREACH")), (any_of(unusual), F.lit("ATTENTION")), (any_of(F.col("status") == "PASS"), F.lit("PASS"))], F.lit("INSUFFICIENT_DATA"))
    return checked.groupBy(key).agg(verdict.alias("overall"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: the upsert of a table whose rows only ever arrive."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def version_in_force(facts: DataFrame, versions: DataFrame, key: str, on: str, effective: str, value: str) -> DataFrame:
    """Each fact with the value of the last version that took effect on or before its date; null before the first.

    Versions are carried on over the different dates of a key alone, which combine before the shuffle, and the facts are
    joined to their date: a key that a third of the facts share is no task's burden.
    """
    v = versions.select(F.col(key).alias("_key"), F.col(effective).alias("_at"), F.lit(0).alias("_turn"), F.struct(F.col(effective).alias("effective"), F.col(value).alias("value")).alias("_version"))
    days = facts.select(F.col(key).alias("_key"), F.col(on).alias("_at")).distinct().select("_key", "_at", F.lit(1).alias("_turn"), F.lit(None).cast(v.schema["_version"].dataType).alias("_version"))
    seen = Window.partitionBy("_key").orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    carried = v.unionByName(days).withColumn("_version", F.last("_version", ignorenulls=True).over(seen)).where("_turn = 1")
    found = facts.join(carried.select("_key", "_at", "_version"), (F.col(key) == F.col("_key")) & (F.col(on) == F.col("_at")), "left")
    return found.select(*facts.columns, F.col("_version.effective").alias(effective), F.col("_version.value").alias(value))


def _deviation(values: Column) -> Column:
    """The population deviation of an array by Welford's updates in its order, rounded as in DuckDB's stddev_pop; Spark's
    takes each update's second factor as delta - delta / n, which ends in other bits. Null if the array is empty."""

    def update(state: Column, x: Column) -> Column:
        n = state["n"] + 1
        mean = state["mean"] + (x - state["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (state["squares"] + (x - mean) * (x - state["mean"])).alias("squares"))

    start = F.struct(*[F.lit(0.0).alias(name) for name in ("n", "mean", "squares")])
    return F.aggregate(values.cast("array<double>"), start, update, lambda s: F.when(s["n"] > 0, F.sqrt(s["squares"] / s["n"])))


def trend_anomalies(history: DataFrame, keys: list[str], order: list[Column], value: str, window: int = 8) -> DataFrame:
    """Each value against the (population) mean and deviation of up to `window` earlier ones of its key.

    Fewer than two earlier values say nothing. A flat history flags any change; else a distance of more than
    three deviations is flagged. Where it is just three, the last bit decides: see _deviation.
    """
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-window, -1)
    x = F.col(value)
    scored = history.select("*", F.count(value).over(before).alias("n"), F.avg(value).over(before).alias("mean"), _deviation(F.collect_list(value).over(before)).alias("deviation"))
    flag = F.when(F.col("n") < 2, "none").when(F.col("deviation") == 0, F.when(x != F.col("mean"), "first_change").otherwise("none"))
    return scored.withColumn("flag", flag.when(F.abs((x - F.col("mean")) / F.col("deviation")) > 3, "jump").otherwise("none"))


def round_robin(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """n rows taken in turn from the groups: first all first rows, then all second ones."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("turn", turn).orderBy("turn", group).limit(n)
