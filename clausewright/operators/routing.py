"""Cost-aware routing of cases to the cheapest adequate method, and the models behind it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import chain

c = F.col
# Routes in the order that settles ties, rule types, and types a rule engine can decide.
ROUTES = ("DETERMINISTIC", "RAG_LLM", "HUMAN")
TYPES = ("A", "B", "C", "D", "E", "F", "G")
DETERMINISTIC_TYPES = ("A", "C", "D", "G")
RISK_WEIGHT = {"high": 3, "medium": 2, "low": 1}


def expected_cost(prompt_chars: Column, model: dict) -> dict[str, tuple[Column, Column]]:
    """Money and seconds of each route for a case; model: parameters of the cost model."""
    tokens = model["prompt_overhead_tokens"] + prompt_chars / 4
    llm = (tokens * model["usd_per_1m_input"] + model["output_tokens"] * model["usd_per_1m_output"]) / 1e6
    return {
        "DETERMINISTIC": (F.lit(model["rule_usd"]), F.lit(model["rule_ms"] / 1000)),
        "RAG_LLM": (llm, F.lit((model["llm_ms"] + model["retrieval_ms"]) / 1000)),
        "HUMAN": (F.lit(model["human_usd"]), F.lit(model["human_ms"] / 1000)),
    }


def route(cases: DataFrame, cost_model: dict, alpha: float, beta: float, gamma: float, min_evidence: float) -> DataFrame:
    """Gates, then the hard override, then the least expected cost: columns route, decision and cost are added.

    Cases have evidence (completeness 0 to 1), applicable (the rule engine applies), conflict (the text
    contradicts the figures), risk (1 to 3), prompt_chars and p_error_<route> of each route. Where nothing
    is evident the case is declined; among equal costs the first route stays.
    """
    costs = expected_cost(c("prompt_chars"), cost_model)
    total = {r: alpha * c(f"p_error_{r}") * c("risk") + beta * costs[r][0] + gamma * costs[r][1] for r in ROUTES}
    best = chain([(F.lit(True) if r == ROUTES[-1] else total[r] <= F.least(*[total[x] for x in ROUTES]), F.lit(r)) for r in ROUTES], F.lit(None))
    none, few = c("evidence") == 0, c("evidence") < min_evidence
    sure = c("applicable") & (c("evidence") == 1) & ~c("conflict")
    chosen = chain([(none, F.lit(None).cast("string")), (few, F.lit("HUMAN")), (sure, F.lit("DETERMINISTIC"))], best)
    routed = cases.withColumn("route", chosen)
    decided = chain([(none, F.lit("INSUFFICIENT_DATA")), (c("route") == "HUMAN", F.lit("REQUIRES_HUMAN_REVIEW"))], F.lit(None).cast("string"))
    return routed.withColumn("decision", decided).withColumn("cost", F.least(*total.values()))


# A contrast with a negation behind it, and words of plans and unfinished work.
CONTRADICTS = r"(?i)\b(?:however|but|whereas|on the other hand)\b[^.]{0,200}\b(?:not|no|never|failed to|yet to|without|lack(?:s|ing)?)\b"
UNCERTAIN = r"(?i)\b(?:plans? to|intends? to|proposes? to|in due course|under preparation|draft|partially|started work|expected to be completed|in the process|being considered|awaited|under watch|flagged)\b"


def features(cases: DataFrame) -> DataFrame:
    """The 19 features of a (rule, evidence) pair, added as columns.

    cases: rule_type, reading (it needs interpretation), needed and given (arrays of field names; `narrative` may be needed too),
    relevance, number_in_text, risk, source_conflict, narrative, history_rule, history_llm (null: unknown). A condition of type C is
    a needed field; type G needs the network alone. A field that only the text may state counts half.
    """
    needed = F.when(c("rule_type") == "G", F.array(F.lit("network_scenario"))).when(c("rule_type") == "C", F.array_union("needed", F.array(F.lit("condition_met")))).otherwise(c("needed"))
    rows = cases.withColumn("_needed", needed).withColumn("_fields", F.array_remove("_needed", "narrative")).withColumn("_told", F.coalesce(c("narrative") != "", F.lit(False)))
    relevant = F.coalesce(c("relevance") >= 0.6, F.lit(False))
    has = lambda k: F.array_contains("given", k)
    part = lambda k: F.when(k == "narrative", F.when(relevant & c("_told"), 1.0).otherwise(0.0)).when(has(k), 1.0).when(relevant & ((k == "requirement_met") | c("number_in_text")), 0.5).otherwise(0.0)
    share = F.when(F.size("_fields") > 0, F.size(F.filter("_fields", has)) / F.size("_fields")).otherwise(0.0)
    whole = F.when(F.size("_needed") > 0, F.aggregate(F.transform("_needed", part), F.lit(0.0), lambda s, x: s + x) / F.size("_needed")).otherwise(0.0)
    rows = rows.withColumn("structured_field_availability", share)
    fits = c("rule_type").isin(*DETERMINISTIC_TYPES) | ((c("rule_type") == "B") & F.array_contains("given", F.lit("requirement_met")))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    risk = chain([(c("risk") == name, F.lit(w)) for name, w in RISK_WEIGHT.items()], F.lit(2)) / 3
    return rows.withColumns(
        {
            **{f"rule_type_{k}": flag(c("rule_type") == k) for k in TYPES},
            "requires_semantic_interpretation": flag(c("reading")),
            "retrieval_confidence": F.greatest(F.least(F.coalesce("relevance", F.lit(0.0)), F.lit(1.0)), F.lit(0.0)),
            "rule_engine_applicability": flag(fits & (F.size("_fields") > 0) & (c("structured_field_availability") == 1)),
            "evidence_completeness": F.round(whole, 3),
            "historical_accuracy_deterministic": F.coalesce("history_rule", F.lit(0.5)),
            "historical_accuracy_rag_llm": F.coalesce("history_llm", F.lit(0.5)),
            "risk_level": risk,
            "source_conflict": flag(c("source_conflict")),
            "narrative_present": flag(c("_told")),
            "text_structured_conflict": flag((c("structured_field_availability") > 0) & c("narrative").rlike(CONTRADICTS)),
            "text_uncertainty_cue": flag(c("narrative").rlike(UNCERTAIN)),
        }
    ).drop("_needed", "_fields", "_told")


def routed_run(cases: DataFrame, cost_model: dict, weights: tuple[float, float, float], min_evidence: float, found: dict[str, Column]) -> DataFrame:
    """route() carried out: route, decision, reason, usd and seconds of every case, a row of audit each.

    found: what the rule engine and the judge decide, by route; a judge that leaves a case open hands it to a human.
    """
    costs = expected_cost(c("prompt_chars"), cost_model)
    routed = route(cases, cost_model, *weights, min_evidence)
    read = chain([(c("route") == name, x) for name, x in found.items()], F.lit(None).cast("string"))
    decided = routed.withColumn("decision", F.coalesce("decision", read, F.lit("REQUIRES_HUMAN_REVIEW")))
    sure = c("applicable") & (c("evidence") == 1) & ~c("conflict")
    reason = chain([(c("evidence") == 0, F.lit("no evidence")), (c("evidence") < min_evidence, F.lit("too little evidence")), (sure, F.lit("the rule engine applies"))], F.lit("least expected cost"))
    spent = lambda i: chain([(c("route") == name, costs[name][i]) for name in ROUTES], F.lit(0.0))
    return decided.withColumns({"reason": reason, "usd": spent(0), "seconds": spent(1)})


def route_static(applicable: Column) -> Column:
    return F.when(applicable, "DETERMINISTIC").otherwise("RAG_LLM")


def route_threshold(applicable: Column, confidence: Column, theta: float) -> Column:
    return chain([(applicable, F.lit("DETERMINISTIC")), (confidence >= theta, F.lit("RAG_LLM"))], F.lit("HUMAN"))


def route_fixed(rule_type: Column) -> Column:
    return F.when(rule_type.isin("A", "B", "C", "D", "G"), "DETERMINISTIC").otherwise("RAG_LLM")


def gated(evidence: Column, least: Column, applicable: Column, conflict: Column, total: dict[str, Column]) -> Column:
    """The route: none without evidence, a human below the evidence needed, the rule engine where it surely fits, else the
    cheapest, the earlier one of equals."""
    cheapest = F.least(*total.values())
    by_cost = chain([(cost == cheapest, F.lit(name)) for name, cost in total.items()], F.lit(None).cast("string"))
    sure = applicable & (evidence == 1) & ~conflict
    return F.when(evidence == 0, F.lit(None).cast("string")).when(evidence < least, "HUMAN").when(sure, "DETERMINISTIC").otherwise(by_cost)


def oracle_route(correct: dict[str, Column]) -> Column:
    """The cheapest route that would be right, a human otherwise."""
    return chain([(correct["DETERMINISTIC"], F.lit("DETERMINISTIC")), (correct["RAG_LLM"], F.lit("RAG_LLM"))], F.lit("HUMAN"))


def retrieval_agreement(top: Column, second: Column, pool: Column) -> Column:
    """How clear a retrieval result is: by the lead of the first over the second, in a pool of fewer than
    three by the score itself."""
    small = chain([(top >= 0.85, F.lit("clear")), (top >= 0.75, F.lit("likely"))], F.lit("unclear"))
    lead = top - F.coalesce(second, F.lit(0.0))
    return F.when(pool < 3, small).otherwise(chain([(lead >= 0.30, F.lit("clear")), (lead >= 0.15, F.lit("likely"))], F.lit("unclear")))


def fit_logistic(rows: DataFrame, features: list[str], label: str, epochs: int = 3000, rate: float = 0.5, ridge: float = 1e-3) -> tuple[list[float], float]:
    """Full-batch gradient descent from the label's log-odds as bias.

    The table is first reduced to its distinct feature rows with their counts, a grouped summary, so the
    epochs run over that alone.
    """
    grid = rows.groupBy(*features).agg(F.count(F.lit(1)).alias("n"), F.sum(c(label).cast("double")).alias("positive")).orderBy(*features).toPandas()
    x, n, pos = grid[features].to_numpy(float), grid["n"].to_numpy(float), grid["positive"].to_numpy(float)
    share = np.clip(pos.sum() / n.sum(), 1e-6, 1 - 1e-6)
    w, b = np.zeros(x.shape[1]), float(np.log(share / (1 - share)))
    for _ in range(epochs):
        miss = n / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - pos
        w -= rate * (x.T @ miss / n.sum() + ridge * w)
        b -= rate * float(miss.sum() / n.sum())
    return w.tolist(), b


def logistic_score(weights: list[float], bias: float, features: list[str]) -> Column:
    z = sum((c(f) * w for f, w in zip(features, weights, strict=True)), F.lit(bias))
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def fit_tree(rows: DataFrame, features: list[str], label: str, depth: int = 5, least: int = 15, gain: float = 0.005) -> dict:
    """An entropy tree with smoothed leaves; each level's statistics are one aggregation of the table."""
    grid = rows.groupBy(*features).agg(F.count(F.lit(1)).alias("n"), F.sum(c(label).cast("double")).alias("p")).orderBy(*features).toPandas()
    x, n, p = grid[features].to_numpy(float), grid["n"].to_numpy(float), grid["p"].to_numpy(float)

    def entropy(pos: float, total: float) -> float:
        q = pos / total if total else 0.0
        return 0.0 if q in (0.0, 1.0) else -(q * np.log2(q) + (1 - q) * np.log2(1 - q))

    def grow(at: np.ndarray, left: int) -> dict:
        total, pos = n[at].sum(), p[at].sum()
        leaf = {"p": (pos + 1) / (total + 2), "n": int(total)}
        if not left or total < 2 * least:
            return leaf
        best = (gain, None, None)
        for j in range(len(features)):
            values = np.unique(x[at, j])
            for t in values[:-1][:: max(1, len(values) // 16)]:
                low = at[x[at, j] <= t]
                nl, pl = n[low].sum(), p[low].sum()
                if min(nl, total - nl) < least:
                    continue
                g = entropy(pos, total) - (nl * entropy(pl, nl) + (total - nl) * entropy(pos - pl, total - nl)) / total
                if g > best[0]:
                    best = (g, j, float(t))
        if best[1] is None:
            return leaf
        low = x[at, best[1]] <= best[2]
        return {"feature": features[best[1]], "at": best[2], "low": grow(at[low], left - 1), "high": grow(at[~low], left - 1)}

    return grow(np.arange(len(n)), depth)


def tree_score(tree: dict) -> Column:
    """A tree as one expression."""
    if "p" in tree:
        return F.lit(float(tree["p"]))
    return F.when(c(tree["feature"]) <= tree["at"], tree_score(tree["low"])).otherwise(tree_score(tree["high"]))
