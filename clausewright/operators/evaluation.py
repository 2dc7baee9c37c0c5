"""Evaluation statistics: ranking quality, classification quality, significance, frontiers."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

c = F.col
#: Ranges of costs that a front is found in.
PARTS = 64


def ranking_quality(first_ranks: DataFrame, rank: str = "rank") -> DataFrame:
    """Hit@1, 3, 5 and MRR@10 from the 1-based rank of the first relevant result (null: none)."""
    hit = lambda k: F.avg(F.when(c(rank) <= k, 1.0).otherwise(0.0)).alias(f"hit_{k}")
    return first_ranks.agg(hit(1), hit(3), hit(5), F.avg(F.when(c(rank) <= 10, 1.0 / c(rank)).otherwise(0.0)).alias("mrr_10"))


def label_quality(cases: DataFrame, gold: str, pred: str) -> DataFrame:
    """label, support, precision, recall, f1 of each gold label, from the counts of (gold, pred) pairs."""
    pairs = cases.groupBy(gold, pred).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(c(gold).alias("label"), c("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(c(gold) == c(pred), c("n")).otherwise(0).alias("hit")), F.struct(c(pred).alias("label"), F.lit(0).cast("long").alias("support"), c("n").alias("predicted"), F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    sums = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit")).where("support > 0")
    ratio = lambda b: F.when(c(b) > 0, c("hit") / c(b)).otherwise(0.0)
    scored = sums.select("label", "support", ratio("predicted").alias("precision"), ratio("support").alias("recall"))
    total = c("precision") + c("recall")
    return scored.withColumn("f1", F.when(total > 0, 2 * c("precision") * c("recall") / total).otherwise(0.0))


def route_metrics(cases: DataFrame, key: list[str]) -> DataFrame:
    """A key's figures over its routed cases (gold, pred, route, cited_right): accuracy, with humans taken as right end to end, false
    positives among the compliant, false negatives among the others that no human saw, shares of escalations and of model calls,
    and how many of the automatic decisions cite the right clause (1 where there are none)."""
    right, human = c("gold") == c("pred"), c("route") == "HUMAN"
    automatic = ~c("route").isin("HUMAN", "NONE")
    share = lambda hit, of: F.coalesce(F.count_if(of & hit) / F.nullif(F.count_if(of), F.lit(0)), F.lit(0.0))
    rate = lambda x: F.avg(x.cast("double"))
    return cases.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        rate(right).alias("accuracy"),
        rate(right | human).alias("end_to_end"),
        share(c("pred") == "NON_COMPLIANT", c("gold") == "COMPLIANT").alias("false_positives"),
        share((c("pred") != "NON_COMPLIANT") & ~human, c("gold") == "NON_COMPLIANT").alias("false_negatives"),
        rate(human).alias("escalated"),
        rate(c("route").isin("RAG_LLM", "LLM_ONLY")).alias("model_calls"),
        F.coalesce(F.count_if(automatic & c("cited_right")) / F.nullif(F.count_if(automatic), F.lit(0)), F.lit(1.0)).alias("cited"),
    )


def simplification_means(rows: DataFrame, key: str) -> DataFrame:
    """Means of a key's simplified clauses: reading grades where both are known, the share that the guard passed, of those with rules
    the share whose rules read the same afterwards, and the share of sentences kept verbatim (a ratio of sums).

    rows: grade_before, grade_after, guard, had_rules, same_rules, verbatim, sentences."""
    both = c("grade_before").isNotNull() & c("grade_after").isNotNull()
    mean = lambda x: F.avg(F.when(both, x))
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        mean(c("grade_before")).alias("grade_before"),
        mean(c("grade_after")).alias("grade_after"),
        F.avg(c("guard").cast("double")).alias("guard_pass"),
        F.avg(F.when(c("had_rules"), c("same_rules").cast("double"))).alias("rule_agreement"),
        (F.sum("verbatim") / F.greatest(F.sum("sentences"), F.lit(1))).alias("verbatim_share"),
    )


def leave_one_out_accuracy(cases: DataFrame, key: list[str], correct: Column) -> DataFrame:
    """Each case with the accuracy of the other cases of its key; 0.5 where there are none."""
    w = Window.partitionBy(*key)
    hit = correct.cast("double")
    n = F.count(F.lit(1)).over(w)
    return cases.withColumn("history", F.when(n > 1, (F.sum(hit).over(w) - hit) / (n - 1)).otherwise(0.5))


def log_loss(q: Column, y: Column) -> Column:
    """Mean log-loss with a clamp."""
    return F.avg(-(y * F.ln(q + 1e-9) + (1 - y) * F.ln(1 - q + 1e-9)))


def mcnemar(b: int, n: int) -> float:
    """Exact two-sided p of b against n - b discordant pairs."""
    return min(1.0, 2 * sum(comb(n, i) for i in range(min(b, n - b) + 1)) / 2**n) if n else 1.0


def cluster_bootstrap(clusters: DataFrame, value: str, weight: str, resamples: int = 2000, seed: int = 11) -> DataFrame:
    """low and high of the 95 % interval of a weighted mean over resampled clusters.

    clusters: one row per cluster (sums of value and weight): a bounded summary. Each resample is a row; draws
    come from a hash of seed, resample and position, so any executor makes the same ones.
    """
    rows = clusters.agg(F.sort_array(F.collect_list(F.struct(c(value).alias("v"), c(weight).alias("w")))).alias("all"))
    tries = clusters.sparkSession.range(resamples).select(c("id").alias("r"))
    drawn = F.transform(F.sequence(F.lit(1), F.size("all")), lambda i: F.element_at("all", (F.pmod(F.xxhash64(F.lit(seed), c("r"), i), F.size("all")) + 1).cast("int")))
    sums = tries.join(F.broadcast(rows)).select("r", drawn.alias("d")).select(F.aggregate("d", F.lit(0.0), lambda s, x: s + x["v"]).alias("v"), F.aggregate("d", F.lit(0.0), lambda s, x: s + x["w"]).alias("w"))
    return sums.select((c("v") / c("w")).alias("m")).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def pareto_front(points: DataFrame, good: str, cost: str) -> DataFrame:
    """Points that no other beats on one axis without losing on the other: a sort by cost in each of up to PARTS ranges of costs, with
    the best of all cheaper ranges carried into it; no self-join and no task that orders all costs."""
    best = points.where(c(cost).isNotNull()).groupBy(cost).agg(F.max(good).alias("_best"))
    edges = sorted(set(best.approxQuantile(cost, [i / PARTS for i in range(1, PARTS)], 0.01)))
    part = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < c(cost))) if edges else F.lit(0)
    ranged = best.withColumn("_part", part)
    earlier = F.max("_top").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    tops = ranged.groupBy("_part").agg(F.max("_best").alias("_top")).select("_part", earlier.alias("_cheaper"))
    within = F.max("_best").over(Window.partitionBy("_part").orderBy(cost).rowsBetween(Window.unboundedPreceding, -1))
    before = F.greatest("_cheaper", within)
    front = ranged.join(F.broadcast(tops), "_part").withColumn("_before", before).where(c("_before").isNull() | (c("_best") > c("_before"))).drop("_part", "_cheaper")
    return points.join(front, [cost]).where(c(good) == c("_best")).drop("_best", "_before")


def weighted_vote(candidates: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """The value with the largest sum of weights for each key, the least of equals."""
    sums = candidates.groupBy(key, value).agg(F.sum(weight).alias("votes"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(c("votes").desc(), value))
    return sums.withColumn("_r", rank).where("_r = 1").drop("_r")


def multiset_overlap(left: DataFrame, right: DataFrame, key: str, word: str) -> DataFrame:
    """Shared word occurrences of two sides of each key as shares of either side."""
    a = left.groupBy(key, word).agg(F.count(F.lit(1)).alias("a"))
    b = right.groupBy(key, word).agg(F.count(F.lit(1)).alias("b"))
    both = a.join(b, [key, word], "full_outer").fillna(0, ["a", "b"])
    sums = both.groupBy(key).agg(F.sum(F.least("a", "b")).alias("shared"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return sums.select(key, F.when(c("a") > 0, c("shared") / c("a")).otherwise(0.0).alias("recall"), F.when(c("b") > 0, c("shared") / c("b")).otherwise(0.0).alias("precision"))
