"""Evaluation, networks, retrieval and routing as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import round_half_up
from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import retrieval as T
from ..operators import routing as M
from .registry import query

c = F.col


def one():
    """A count of rows."""
    return F.count(F.lit(1))



# --- evaluation ------------------------------------------------------------------------------------------------

_RANKS = "SELECT doc_id, CASE WHEN n_chars % 13 < 11 THEN n_chars % 13 + 1 END AS rank FROM {documents}"


@query("a15_ranking_quality", f"SELECT round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 9) AS hit_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 9) AS hit_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 9) AS hit_5, round(avg(CASE WHEN rank <= 10 THEN CAST(1 AS DOUBLE) / rank ELSE 0.0 END), 9) AS mrr_10 FROM ({_RANKS}) x")
def _(t):
    found = E.ranking_quality(t.sql(_RANKS))
    return found.select(*[F.round(x, 9).alias(x) for x in found.columns])


@query("a16_label_quality", """
SELECT label, support, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM (
  SELECT g.label, g.n AS support, CASE WHEN coalesce(d.n, 0) > 0 THEN coalesce(h.n, 0) / CAST(d.n AS DOUBLE) ELSE 0 END AS p, coalesce(h.n, 0) / CAST(g.n AS DOUBLE) AS r
  FROM (SELECT gold AS label, count(*) AS n FROM {a_cases} GROUP BY gold) g LEFT JOIN (SELECT pred AS label, count(*) AS n FROM {a_cases} GROUP BY pred) d USING (label)
  LEFT JOIN (SELECT gold AS label, count(*) AS n FROM {a_cases} WHERE gold = pred GROUP BY gold) h USING (label)) x""")
def _(t):
    return E.label_quality(t.a_cases, "gold", "pred").select("label", "support", *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")])


@query("a16_median_cost", "SELECT rule_type, cost AS median FROM (SELECT rule_type, cost, row_number() OVER (PARTITION BY rule_type ORDER BY cost, case_id) - 1 AS i, count(*) OVER (PARTITION BY rule_type) AS n FROM {a_cases}) x WHERE i = n // 2")
def _(t):
    w = Window.partitionBy("rule_type")
    placed = t.a_cases.select("rule_type", "cost", (F.row_number().over(w.orderBy("cost", "case_id")) - 1).alias("i"), one().over(w).alias("n"))
    return placed.where(c("i") == F.floor(c("n") / 2)).select("rule_type", c("cost").alias("median"))


@query("a17_accuracy_by_key", "SELECT rule_type, count(*) AS n, round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM {a_cases} GROUP BY rule_type")
def _(t):
    return t.a_cases.groupBy("rule_type").agg(one().alias("n"), F.round(F.avg((c("gold") == c("pred")).cast("double")), 9).alias("accuracy"))


@query("a18_leave_one_out", "SELECT case_id, round(CASE WHEN n > 1 THEN (s - h) / (n - 1) ELSE 0.5 END, 9) AS history FROM (SELECT case_id, CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END AS h, sum(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY rule_type, modality) AS s, count(*) OVER (PARTITION BY rule_type, modality) AS n FROM {a_cases}) x")
def _(t):
    return E.leave_one_out_accuracy(t.a_cases, ["rule_type", "modality"], c("gold") == c("pred")).select("case_id", F.round("history", 9).alias("history"))


@query("a19_log_loss", "SELECT rule_type, round(avg(-(y * ln(q + 1e-9) + (1 - y) * ln(1 - q + 1e-9))), 9) AS loss FROM (SELECT rule_type, CAST(toxic AS DOUBLE) AS y, (cost % 97 + 1) / CAST(100 AS DOUBLE) AS q FROM {a_cases}) x GROUP BY rule_type")
def _(t):
    q, y = (c("cost") % 97 + 1) / 100.0, c("toxic").cast("double")
    return t.a_cases.groupBy("rule_type").agg(F.round(E.log_loss(q, y), 9).alias("loss"))


@query("a20_discordant_pairs", "SELECT count(*) FILTER (gold = pred AND toxic = 1) AS b, count(*) FILTER (gold <> pred AND toxic = 0) AS c2 FROM {a_cases}")
def _(t):
    return t.a_cases.agg(F.count_if((c("gold") == c("pred")) & (c("toxic") == 1)).alias("b"), F.count_if((c("gold") != c("pred")) & (c("toxic") == 0)).alias("c2"))


@query("a20_cluster_bootstrap")
def _(t):
    clusters = t.a_cases.groupBy("modality").agg(F.sum((c("gold") == c("pred")).cast("double")).alias("v"), one().cast("double").alias("w"))
    return E.cluster_bootstrap(clusters, "v", "w")


@query("a21_pareto_front", "SELECT case_id FROM {a_cases} a WHERE NOT EXISTS (SELECT 1 FROM {a_cases} b WHERE (b.case_id % 1000 >= a.case_id % 1000 AND b.cost < a.cost) OR (b.case_id % 1000 > a.case_id % 1000 AND b.cost <= a.cost))")
def _(t):
    return E.pareto_front(t.a_cases.select("case_id", "cost", (c("case_id") % 1000).alias("good")), "good", "cost").select("case_id")


@query("a22_bm25_statistics", r"SELECT word, count(DISTINCT chunk_id) AS df, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS word FROM {a_chunks}) x WHERE word <> '' GROUP BY word")
def _(t):
    return T.postings(t.a_chunks).groupBy(c("term").alias("word")).agg(one().alias("df"), F.sum("tf").alias("tf"))


@query("a23_weighted_vote", "SELECT source, lang, votes FROM (SELECT source, lang, sum(n_chars) AS votes, row_number() OVER (PARTITION BY source ORDER BY sum(n_chars) DESC, lang) AS rn FROM {documents} GROUP BY source, lang) x WHERE rn = 1")
def _(t):
    return E.weighted_vote(t.documents, "source", "lang", "n_chars").select("source", "lang", "votes")


@query("a24_multiset_overlap", r"""
SELECT k, round(sum(least(a, b)) / CAST(sum(a) AS DOUBLE), 9) AS recall, round(sum(least(a, b)) / CAST(sum(b) AS DOUBLE), 9) AS precision FROM (
  SELECT coalesce(x.k, y.k) AS k, coalesce(x.n, 0) AS a, coalesce(y.n, 0) AS b FROM
   (SELECT lang AS k, word, count(*) AS n FROM (SELECT lang, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS word FROM {documents} WHERE source < 'src2') p WHERE word <> '' GROUP BY ALL) x FULL JOIN
   (SELECT lang AS k, word, count(*) AS n FROM (SELECT lang, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS word FROM {documents} WHERE source >= 'src2') q WHERE word <> '' GROUP BY ALL) y ON x.k = y.k AND x.word = y.word) z GROUP BY k""")
def _(t):
    side = lambda cond: t.documents.where(cond).select(c("lang").alias("k"), F.explode(T.terms(c("text"))).alias("word"))
    found = E.multiset_overlap(side("source < 'src2'"), side("source >= 'src2'"), "k", "word")
    return found.select("k", *[F.round(x, 9).alias(x) for x in ("recall", "precision")])


@query("a27_evidence_completeness", "SELECT case_id, round(list_aggregate(list_transform([cost % 2, cost % 3, cost % 5], lambda x: CASE WHEN x = 0 THEN 1.0 WHEN x = 1 THEN 0.5 ELSE 0.0 END), 'sum') / 3, 9) AS completeness FROM {a_cases}")
def _(t):
    fields = F.array(*[c("cost") % k for k in (2, 3, 5)])
    score = F.aggregate(F.transform(fields, lambda x: F.when(x == 0, 1.0).when(x == 1, 0.5).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x) / F.size(fields)
    return t.a_cases.select("case_id", F.round(score, 9).alias("completeness"))


@query("a30_means_by_category", "SELECT lang, round(avg(n_chars), 6) AS mean_chars, round(sum(CASE WHEN n_chars > 1000 THEN n_chars ELSE 0 END) / CAST(sum(n_chars) AS DOUBLE), 9) AS long_share FROM {documents} GROUP BY lang")
def _(t):
    return t.documents.groupBy("lang").agg(F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.round(F.sum(F.when(c("n_chars") > 1000, c("n_chars")).otherwise(0)) / F.sum("n_chars"), 9).alias("long_share"))


@query("a33_set_agreement", "SELECT round(avg(CASE WHEN x.s = y.s THEN 1.0 ELSE 0.0 END), 9) AS rate FROM (SELECT brand, list_sort(list(DISTINCT operator)) AS s FROM {a_rules} WHERE atom_kind = 'requirement' GROUP BY brand) x LEFT JOIN (SELECT brand, list_sort(list(DISTINCT operator)) AS s FROM {a_rules} WHERE atom_kind = 'condition' GROUP BY brand) y USING (brand)")
def _(t):
    side = lambda kind, name: t.a_rules.where(c("atom_kind") == kind).groupBy("brand").agg(F.sort_array(F.collect_set("operator")).alias(name))
    both = side("requirement", "x").join(side("condition", "y"), "brand", "left")
    return both.agg(F.round(F.avg(F.coalesce(c("x") == c("y"), F.lit(False)).cast("double")), 9).alias("rate"))


@query("a34_confusion_matrix", "SELECT g.label AS gold, p.label AS pred, coalesce(n, 0) AS n, round(coalesce(n, 0) / CAST(greatest(sum(coalesce(n, 0)) OVER (PARTITION BY g.label), 1) AS DOUBLE), 9) AS share FROM (VALUES ('COMPLIANT'), ('NON_COMPLIANT')) g(label) JOIN (VALUES ('COMPLIANT'), ('NON_COMPLIANT'), ('REQUIRES_HUMAN_REVIEW')) p(label) ON true LEFT JOIN (SELECT gold, pred, count(*) AS n FROM {a_cases} GROUP BY gold, pred) x ON x.gold = g.label AND x.pred = p.label")
def _(t):
    labels = ["COMPLIANT", "NON_COMPLIANT", "REQUIRES_HUMAN_REVIEW"]
    all_pairs = t.spark.createDataFrame([(g, p) for g in labels[:2] for p in labels], "gold string, pred string")
    counted = all_pairs.join(t.a_cases.groupBy("gold", "pred").agg(one().alias("n")), ["gold", "pred"], "left").fillna(0, ["n"])
    return counted.withColumn("share", F.round(c("n") / F.greatest(F.sum("n").over(Window.partitionBy("gold")), F.lit(1)), 9))


@query("a35_route_mix", "SELECT rule_type, count(*) FILTER (route = 'DETERMINISTIC') AS deterministic, count(*) FILTER (route = 'RAG_LLM') AS rag_llm, count(*) FILTER (route = 'HUMAN') AS human FROM {a_cases} GROUP BY rule_type")
def _(t):
    mix = t.a_cases.groupBy("rule_type").pivot("route", list(M.ROUTES)).agg(one()).fillna(0)
    return mix.select("rule_type", *[c(r).alias(r.lower()) for r in M.ROUTES])


# --- networks --------------------------------------------------------------------------------------------------

_LIVE = "SELECT * FROM {a_edges} WHERE status = 'confirmed'"
_CONTROL = f"SELECT DISTINCT from_entity, to_entity FROM ({_LIVE}) l WHERE (edge_type = 'CONTROLS' OR (edge_type = 'OWNS' AND pct > 50)) AND from_entity <> to_entity AND from_entity NOT IN (SELECT entity_id FROM {{a_entities}} WHERE entity_type = 'sovereign')"


@query("g01_control_edges", _CONTROL)
def _(t):
    return G.control_edges(G.usable(t.a_edges), t.a_entities)


def _closure_sql(select):
    from .views import VIEWS

    tables = {k: VIEWS[k].replace("{customer}", "customer").strip() for k in ("a_entities", "a_edges")}
    control = _CONTROL.replace("{a_edges}", "a_edges").replace("{a_entities}", "a_entities")
    return f"WITH RECURSIVE a_entities AS ({tables['a_entities']}),\na_edges AS ({tables['a_edges']}),\ncontrol AS ({control}),\nreach AS (SELECT from_entity, to_entity FROM control UNION SELECT r.from_entity, x.to_entity FROM reach r JOIN control x ON x.from_entity = r.to_entity)\n{select}"


@query("g02_control_closure", _closure_sql("SELECT from_entity, to_entity FROM reach"))
def _(t):
    return G.closure(G.control_edges(G.usable(t.a_edges), t.a_entities))


@query("g03_ultimate_controllers")
def _(t):
    control = G.control_edges(G.usable(t.a_edges), t.a_entities)
    return G.ultimate_controllers(control, G.closure(control))


@query("g04_g06_connected_groups")
def _(t):
    return G.connected_groups(t.a_edges, t.a_entities).select("group_id", "root", "size", F.concat_ws(",", c("members").cast("array<string>")).alias("members"))


_LEGS = """
SELECT entity_id, part, exempt OR s.id IS NOT NULL AS exempt, infrastructure, kind, board_approved, received FROM (
  SELECT entity_id, greatest(amount - least(greatest(coalesce(crm, 0), 0), amount), 0) AS part, exempt_reason IS NOT NULL AS exempt, infrastructure, coalesce(kind, 'fund_based') AS kind, board_approved, 0 AS received FROM {a_exposures}
  UNION ALL SELECT crm_provider, least(greatest(crm, 0), amount), false, false, 'crm_substitution', false, least(greatest(crm, 0), amount) FROM {a_exposures} WHERE crm > 0 AND amount > 0 AND crm_provider IS NOT NULL) l
  LEFT JOIN (SELECT entity_id AS id FROM {a_entities} WHERE entity_type = 'sovereign') s ON s.id = l.entity_id"""
_TOTALS = f"SELECT entity_id, CAST(coalesce(sum(part) FILTER (NOT exempt), 0) AS BIGINT) AS total, CAST(coalesce(sum(part) FILTER (exempt), 0) AS BIGINT) AS exempt, CAST(coalesce(sum(part) FILTER (NOT exempt AND infrastructure), 0) AS BIGINT) AS infrastructure, CAST(coalesce(sum(part) FILTER (NOT exempt AND kind = 'equity'), 0) AS BIGINT) AS equity, CAST(sum(received) AS BIGINT) AS crm_received, bool_or(board_approved) AS board_approved FROM ({_LEGS}) x GROUP BY entity_id"


@query("a06_g07_exposures", _TOTALS)
def _(t):
    return G.aggregate_exposures(t.a_exposures, t.a_entities)


@query("a08_intra_group_sum", f"SELECT entity_type, CAST(sum(greatest(total - equity, 0)) AS BIGINT) AS total FROM ({_TOTALS}) y JOIN {{a_entities}} USING (entity_id) GROUP BY entity_type")
def _(t):
    totals = G.aggregate_exposures(t.a_exposures, t.a_entities)
    return totals.join(t.a_entities, "entity_id").groupBy("entity_type").agg(F.sum(F.greatest(c("total") - c("equity"), F.lit(0))).alias("total"))


@query("g08_own_group", "SELECT entity_id, arg_min(relation, turn) AS relation FROM (SELECT to_entity AS entity_id, 1 AS turn, 'subsidiary_or_associate' AS relation FROM {a_edges} WHERE from_entity = 10 AND ((edge_type = 'OWNS' AND pct >= 20) OR edge_type = 'CONTROLS') UNION ALL SELECT from_entity, 2, 'parent_or_promoter' FROM {a_edges} WHERE to_entity = 10 AND ((edge_type = 'OWNS' AND pct >= 20) OR edge_type = 'CONTROLS') UNION ALL SELECT to_entity, 3, 'held_by_parent' FROM {a_edges} WHERE edge_type = 'OWNS' AND pct >= 20 AND from_entity IN (SELECT from_entity FROM {a_edges} WHERE to_entity = 10 AND ((edge_type = 'OWNS' AND pct >= 20) OR edge_type = 'CONTROLS'))) x WHERE entity_id <> 10 GROUP BY entity_id")
def _(t):
    return G.own_group(t.a_edges, 10)


_BASE = 5_000_000.0
_LIMITS = "CASE WHEN entity_type = 'nbfc' AND gold_loan THEN 7.5 WHEN entity_type = 'bank' THEN 25.0 ELSE 20.0 END"
_LIMITED = f"""
SELECT entity_id, status, CASE WHEN status = 'PASS' THEN lim ELSE ext END AS allowed, pct, total FROM (
  SELECT *, CASE WHEN pct <= lim THEN 'PASS' WHEN pct <= ext THEN 'PASS_WITH_CONDITIONS' ELSE 'BREACH' END AS status FROM (
    SELECT entity_id, total, total / {_BASE} * 100 AS pct, CAST(lim AS DOUBLE) AS lim,
           least(CAST(lim AS DOUBLE) + CASE WHEN infrastructure > 0 THEN least(5.0, infrastructure / {_BASE} * 100) ELSE 0 END + CASE WHEN board_approved THEN 5 ELSE 0 END, 25.0) AS ext
    FROM (SELECT y.*, {_LIMITS} AS lim FROM ({_TOTALS}) y JOIN {{a_entities}} USING (entity_id)) z) w) v"""


@query("g10_g12_single_limits", f"SELECT entity_id, status, floor(pct * 100 + 0.5) / 100 AS exposure_pct, floor(allowed * 100 + 0.5) / 100 AS allowed_pct, floor((allowed / 100 * {_BASE} - total) * 100 + 0.5) / 100 AS headroom FROM ({_LIMITED}) u")
def _(t):
    limits = G.pick_limit(G.counterparty_classes(t.a_entities), {"default": 20.0, "bank": 25.0, "gold_nbfc": 7.5})
    rows = G.aggregate_exposures(t.a_exposures, t.a_entities).join(limits, "entity_id")
    return G.limit_check(rows, "total", _BASE, c("limit_pct"), 5, 5, 25.0).select("entity_id", "status", "exposure_pct", "allowed_pct", "headroom")


@query("a07_g13_group_limits")
def _(t):
    found = G.group_checks(t.a_edges, t.a_entities, t.a_exposures, _BASE, 25.0, 20.0)
    return found.select("root", "provisional", "total", "limit_pct", "exposure_pct", "status")


@query("g14_large_exposures", f"SELECT entity_id, total + exempt AS reported, 'REPORTABLE' AS status FROM ({_TOTALS}) y WHERE (total + exempt) / {_BASE} * 100 >= 10")
def _(t):
    totals = G.aggregate_exposures(t.a_exposures, t.a_entities).withColumn("reported", c("total") + c("exempt"))
    return totals.where(c("reported") / _BASE * 100 >= 10).select("entity_id", "reported", F.lit("REPORTABLE").alias("status"))


@query("g15_dependence_assessment", f"SELECT entity_id FROM ({_TOTALS}) y WHERE total / {_BASE} * 100 > 5 AND entity_id NOT IN (SELECT from_entity FROM {{a_edges}} WHERE edge_type = 'ECONOMIC_DEPENDENCE' UNION SELECT to_entity FROM {{a_edges}} WHERE edge_type = 'ECONOMIC_DEPENDENCE')")
def _(t):
    seen = t.a_edges.where("edge_type = 'ECONOMIC_DEPENDENCE'")
    seen = seen.select(c("from_entity").alias("entity_id")).union(seen.select("to_entity"))
    totals = G.aggregate_exposures(t.a_exposures, t.a_entities)
    return totals.where(c("total") / _BASE * 100 > 5).join(seen, "entity_id", "left_anti").select("entity_id")


@query("a28_network_summary", f"SELECT count(*) FILTER (total > 0) AS counterparties, CAST(sum(total) AS BIGINT) AS total, CAST(sum(exempt) AS BIGINT) AS exempt, CAST(max(total) AS BIGINT) AS largest FROM ({_TOTALS}) y")
def _(t):
    return G.aggregate_exposures(t.a_exposures, t.a_entities).agg(F.count_if(c("total") > 0).alias("counterparties"), F.sum("total").alias("total"), F.sum("exempt").alias("exempt"), F.max("total").alias("largest"))


@query("g18_display_nodes", "SELECT e.entity_id, e.entity_type, count(x.to_entity) AS links FROM {a_entities} e LEFT JOIN {a_edges} x ON x.from_entity = e.entity_id AND x.status <> 'rebutted' GROUP BY ALL")
def _(t):
    links = G.usable(t.a_edges, True).groupBy(c("from_entity").alias("entity_id")).agg(one().alias("links"))
    return t.a_entities.join(links, "entity_id", "left").select("entity_id", "entity_type", F.coalesce("links", F.lit(0)).alias("links"))


@query("c39_edge_sentences", "SELECT from_entity, to_entity, CASE edge_type WHEN 'OWNS' THEN concat(from_entity, ' holds ', CAST(pct AS INT), '% of ', to_entity) WHEN 'CONTROLS' THEN concat(from_entity, ' controls ', to_entity) WHEN 'COMMON_MANAGEMENT' THEN concat(from_entity, ' shares its management with ', to_entity) WHEN 'ECONOMIC_DEPENDENCE' THEN concat(from_entity, ' depends on ', to_entity) WHEN 'DIRECTOR_OF' THEN concat(from_entity, ' is a director of ', to_entity) ELSE concat(from_entity, ' is related to ', to_entity) END AS sentence FROM {a_edges}")
def _(t):
    return t.a_edges.select("from_entity", "to_entity", G.edge_sentence().alias("sentence"))


@query("j19_three_hops", "SELECT a.from_entity AS start, count(*) AS paths FROM {a_edges} a JOIN {a_edges} b ON b.from_entity = a.to_entity JOIN {a_edges} c ON c.from_entity = b.to_entity WHERE a.status <> 'rebutted' AND b.status <> 'rebutted' AND c.status <> 'rebutted' GROUP BY a.from_entity")
def _(t):
    hop = G.usable(t.a_edges, True).select("from_entity", "to_entity")
    two = hop.alias("a").join(hop.alias("b"), c("a.to_entity") == c("b.from_entity")).select(c("a.from_entity").alias("start"), c("b.to_entity").alias("at"))
    return two.join(hop, c("at") == c("from_entity")).groupBy("start").agg(one().alias("paths"))


# --- retrieval -------------------------------------------------------------------------------------------------

_BM25 = r"""
SELECT question_id, chunk_id, sum(ln(1 + (nn - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM
 (SELECT DISTINCT question_id, term FROM (SELECT question_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM {a_questions}) q0 WHERE term <> '') q JOIN
 (SELECT *, CAST(count(*) OVER (PARTITION BY term) AS DOUBLE) AS df FROM (SELECT chunk_id, term, CAST(count(*) AS DOUBLE) AS tf, any_value(len) AS len FROM (
    SELECT chunk_id, len(list_filter(w, lambda x: x <> '')) AS len, unnest(w) AS term FROM (SELECT chunk_id, regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') AS w FROM {a_chunks}) c0) c1 WHERE term <> '' GROUP BY chunk_id, term) c2) p USING (term),
 (SELECT CAST(count(*) AS DOUBLE) AS nn, avg(len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS mean FROM {a_chunks}) s GROUP BY question_id, chunk_id"""


@query("r01_bm25", f"SELECT question_id, chunk_id, round(score, 6) AS score FROM ({_BM25}) x")
def _(t):
    return T.bm25(t.a_chunks, t.a_questions).select("question_id", "chunk_id", F.round("score", 6).alias("score"))


@query("o02_bm25_top", f"SELECT question_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 6) DESC, chunk_id) AS rn FROM ({_BM25}) x) y WHERE rn <= 10")
def _(t):
    scores = T.bm25(t.a_chunks, t.a_questions).withColumn("score", F.round("score", 6))
    return T.ranked(scores, "question_id", "chunk_id").where("rank < 10").select("question_id", "chunk_id")


@query("r03_term_coverage", "SELECT chunk_id, round(len(list_filter(['the', 'ing', 'tion', 'xyz'], lambda w: contains(lower(text), w))) / CAST(4 AS DOUBLE), 9) AS coverage FROM {a_chunks}")
def _(t):
    words = F.array(*[F.lit(w) for w in ("the", "ing", "tion", "xyz")])
    return t.a_chunks.select("chunk_id", F.round(T.coverage(c("text"), words), 9).alias("coverage"))


_LISTS = "SELECT vec_id % 5 AS q, vec_id AS k, row_number() OVER (PARTITION BY vec_id % 5 ORDER BY {by}, vec_id) - 1 AS rank FROM {{embeddings}} WHERE {keep}"
_LEX, _SEM = _LISTS.format(by="label DESC", keep="label > 3"), _LISTS.format(by="label", keep="label < 7")


@query("u01_r05_fusion", f"SELECT coalesce(a.q, b.q) AS q, coalesce(a.k, b.k) AS k, a.rank AS lexical_rank, b.rank AS semantic_rank, round(coalesce(CAST(1 AS DOUBLE) / (61 + a.rank), 0) + coalesce(CAST(1 AS DOUBLE) / (61 + b.rank), 0), 12) AS score FROM ({_LEX}) a FULL JOIN ({_SEM}) b ON a.q = b.q AND a.k = b.k")
def _(t):
    rows = t.embeddings.select((c("vec_id") % 5).alias("q"), c("vec_id").alias("k"), "label")
    lexical = T.ranked(rows.where("label > 3"), "q", "k", "label")
    semantic = T.ranked(rows.where("label < 7").withColumn("down", -c("label")), "q", "k", "down")
    return T.fuse(lexical, semantic, "q", "k").withColumn("score", F.round("score", 12))


@query("r06_boosts", "SELECT chunk_id, round(CAST(1 AS DOUBLE) * CASE WHEN category = 'de' THEN 1.6 ELSE 1.0 END * CASE WHEN category = 'fr' THEN 0.75 ELSE 1.0 END * CASE WHEN chunk_id % 2 = 0 THEN 1.5 ELSE 1.0 END * CASE WHEN chunk_id % 3 = 0 THEN 1.25 ELSE 1.0 END * CASE WHEN chunk_id % 5 = 0 THEN 0.55 ELSE 1.0 END, 9) AS score, (category = 'de')::INT + (category = 'fr')::INT + (chunk_id % 2 = 0)::INT + (chunk_id % 3 = 0)::INT + (chunk_id % 5 = 0)::INT AS reasons FROM {a_chunks}")
def _(t):
    score, reasons = T.boosted(F.lit(1.0), c("category") == "de", c("category") == "fr", c("chunk_id") % 2 == 0, c("chunk_id") % 3 == 0, c("chunk_id") % 5 == 0)
    return t.a_chunks.select("chunk_id", F.round(score, 9).alias("score"), F.size(reasons).alias("reasons"))


@query("r07_hybrid_search")
def _(t):
    lexical = T.ranked(T.bm25(t.a_chunks, t.a_questions).withColumn("score", F.round("score", 6)), "question_id", "chunk_id").where("rank < 60")
    words = t.a_questions.select("question_id", F.array_distinct(T.terms(c("text"))).alias("words"))
    covered = lexical.join(words, "question_id").join(t.a_chunks, "chunk_id").withColumn("cover", F.round(T.coverage(c("text"), c("words")), 9))
    again = T.ranked(covered.select("question_id", "chunk_id", "cover"), "question_id", "chunk_id", "cover")
    fused = T.fuse(lexical, again, "question_id", "chunk_id").join(t.a_chunks.select("chunk_id", "doc", "category"), "chunk_id")
    score, reasons = T.boosted(c("score"), c("category") == "en", c("category") == "fr", F.lit(False), F.lit(False), F.lit(False))
    return T.diversified(fused.withColumn("score", score).withColumn("reasons", F.concat_ws(",", reasons)), "question_id", "chunk_id", "doc", 2, 8).select("question_id", "chunk_id", "place", F.round("score", 9).alias("score"), "reasons")


@query("r10_context_packing")
def _(t):
    return T.packed_context(t.a_chunks, "category", [c("chunk_id")], F.length("text").cast("long"), 16_000).select("category", "used", c("block.chunk_id").alias("chunk_id"))


@query("k04_fixed_windows", "SELECT chunk_id, count(*) AS n FROM (SELECT chunk_id, unnest(range(0, CAST(ceil(greatest(length(text) - 800, 0) / 600.0) AS BIGINT) + 1)) AS i FROM {a_chunks}) x GROUP BY chunk_id")
def _(t):
    return T.sliding_windows(t.a_chunks, "chunk_id", "text", 800, 200).groupBy("chunk_id").agg(one().alias("n"))


# --- routing ---------------------------------------------------------------------------------------------------

#: Parameters of the cost model, in dollars and milliseconds.
COSTS = {"prompt_overhead_tokens": 600, "usd_per_1m_input": 0.3, "usd_per_1m_output": 2.5, "output_tokens": 400, "rule_usd": 0.0, "rule_ms": 0.02, "llm_ms": 1800, "retrieval_ms": 60, "human_usd": 1.5, "human_ms": 600_000}
_CASE_FEATURES = "SELECT case_id, CAST(cost % 4 AS DOUBLE) / 3 AS evidence, cost % 3 = 0 AS applicable, cost % 7 = 0 AS conflict, CAST(cost % 3 + 1 AS DOUBLE) AS risk, cost AS prompt_chars, CAST(cost % 10 AS DOUBLE) / 10 AS p_error_DETERMINISTIC, CAST(cost % 9 AS DOUBLE) / 20 AS p_error_RAG_LLM, CAST(0.02 AS DOUBLE) AS p_error_HUMAN FROM {a_cases}"
_A, _B, _G = 1.0, 0.5, 0.0001
_TOTAL = {"DETERMINISTIC": f"({_A} * p_error_DETERMINISTIC * risk + {_G} * 0.00002)", "RAG_LLM": f"({_A} * p_error_RAG_LLM * risk + {_B} * ((600 + prompt_chars / 4) * 0.3 + 1000) / 1000000 + {_G} * 1.86)", "HUMAN": f"({_A} * p_error_HUMAN * risk + {_B} * 1.5 + {_G} * 600)"}
_ROUTE_SQL = f"CASE WHEN evidence = 0 THEN NULL WHEN evidence < 0.4 THEN 'HUMAN' WHEN applicable AND evidence = 1 AND NOT conflict THEN 'DETERMINISTIC' WHEN {_TOTAL['DETERMINISTIC']} <= least({_TOTAL['RAG_LLM']}, {_TOTAL['HUMAN']}) THEN 'DETERMINISTIC' WHEN {_TOTAL['RAG_LLM']} <= {_TOTAL['HUMAN']} THEN 'RAG_LLM' ELSE 'HUMAN' END"


@query("m02_m03_adaptive_route", f"SELECT case_id, route, CASE WHEN evidence = 0 THEN 'INSUFFICIENT_DATA' WHEN route = 'HUMAN' THEN 'REQUIRES_HUMAN_REVIEW' END AS decision FROM (SELECT *, {_ROUTE_SQL} AS route FROM ({_CASE_FEATURES}) x) y")
def _(t):
    return M.route(t.sql(_CASE_FEATURES), COSTS, _A, _B, _G, 0.4).select("case_id", "route", "decision")


@query("m04_baseline_routes", "SELECT case_id, CASE WHEN cost % 3 = 0 THEN 'DETERMINISTIC' ELSE 'RAG_LLM' END AS static, CASE WHEN cost % 3 = 0 THEN 'DETERMINISTIC' WHEN (cost % 100) / CAST(100 AS DOUBLE) >= 0.85 THEN 'RAG_LLM' ELSE 'HUMAN' END AS threshold, CASE WHEN rule_type IN ('A', 'B', 'C', 'D', 'G') THEN 'DETERMINISTIC' ELSE 'RAG_LLM' END AS fixed FROM {a_cases}")
def _(t):
    ready = c("cost") % 3 == 0
    return t.a_cases.select("case_id", M.route_static(ready).alias("static"), M.route_threshold(ready, (c("cost") % 100) / 100.0, 0.85).alias("threshold"), M.route_fixed(c("rule_type")).alias("fixed"))


@query("m05_retrieval_agreement", "SELECT case_id, CASE WHEN pool < 3 THEN CASE WHEN top >= 0.85 THEN 'clear' WHEN top >= 0.75 THEN 'likely' ELSE 'unclear' END ELSE CASE WHEN top - second >= 0.30 THEN 'clear' WHEN top - second >= 0.15 THEN 'likely' ELSE 'unclear' END END AS agreement FROM (SELECT case_id, (cost % 100) / CAST(100 AS DOUBLE) AS top, (cost % 37) / CAST(100 AS DOUBLE) AS second, cost % 6 AS pool FROM {a_cases}) x")
def _(t):
    return t.a_cases.select("case_id", M.retrieval_agreement((c("cost") % 100) / 100.0, (c("cost") % 37) / 100.0, c("cost") % 6).alias("agreement"))


#: The points of the grid: weights of money and of time, and the evidence needed.
_BETAS, _GAMMAS, _LEAST = (0.1, 0.3, 1.0, 3.0, 10.0, 30.0), (0.0, 1e-4, 1e-3, 1e-2), (0.5, 0.75, 1.0)
_GRID = "(VALUES " + ", ".join(f"({b}::DOUBLE, {g}::DOUBLE, {e}::DOUBLE)" for b in _BETAS for g in _GAMMAS for e in _LEAST) + ") g(beta, gamma, least)"


@query("m08_grid_search", f"""
SELECT beta, gamma, least, n, escalated, correct >= 0.5 * n AS feasible FROM (
  SELECT beta, gamma, least, count(*) AS n, count(*) FILTER (route = 'HUMAN') AS escalated, count(*) FILTER (route = 'HUMAN' OR (route = 'RAG_LLM' AND prompt_chars % 3 = 0) OR (route = 'DETERMINISTIC' AND prompt_chars % 2 = 0)) AS correct FROM (
    SELECT *, CASE WHEN evidence = 0 THEN NULL WHEN evidence < least THEN 'HUMAN' WHEN applicable AND evidence = 1 AND NOT conflict THEN 'DETERMINISTIC' WHEN d <= least(r, h) THEN 'DETERMINISTIC' WHEN r <= h THEN 'RAG_LLM' ELSE 'HUMAN' END AS route FROM (
      SELECT x.*, g.beta, g.gamma, g.least, p_error_DETERMINISTIC * risk AS d, p_error_RAG_LLM * risk + beta * 0.001 + gamma * 2.0 AS r, p_error_HUMAN * risk + beta * 1.5 + gamma * 600.0 AS h FROM ({_CASE_FEATURES}) x JOIN {_GRID} ON true) y) z GROUP BY beta, gamma, least) s""")
def _(t):
    grid = t.spark.createDataFrame([(b, g, e) for b in _BETAS for g in _GAMMAS for e in _LEAST], "beta double, gamma double, least double")
    cases = t.sql(_CASE_FEATURES).groupBy("evidence", "applicable", "conflict", "risk", "p_error_DETERMINISTIC", "p_error_RAG_LLM", "p_error_HUMAN", (c("prompt_chars") % 6).alias("k")).agg(one().alias("m"))
    total = {"d": c("p_error_DETERMINISTIC") * c("risk"), "r": c("p_error_RAG_LLM") * c("risk") + c("beta") * 0.001 + c("gamma") * 2.0, "h": c("p_error_HUMAN") * c("risk") + c("beta") * 1.5 + c("gamma") * 600.0}
    costs = cases.crossJoin(F.broadcast(grid)).withColumns(total)
    route = M.gated(c("evidence"), c("least"), c("applicable"), c("conflict"), {"DETERMINISTIC": c("d"), "RAG_LLM": c("r"), "HUMAN": c("h")})
    correct = (c("route") == "HUMAN") | ((c("route") == "RAG_LLM") & (c("k") % 3 == 0)) | ((c("route") == "DETERMINISTIC") & (c("k") % 2 == 0))
    sums = costs.withColumn("route", route).groupBy("beta", "gamma", "least").agg(F.sum("m").alias("n"), F.sum(F.when(c("route") == "HUMAN", c("m")).otherwise(0)).alias("escalated"), F.sum(F.when(correct, c("m")).otherwise(0)).alias("correct"))
    return sums.select("beta", "gamma", "least", "n", "escalated", (c("correct") >= 0.5 * c("n")).alias("feasible"))


@query("m11_oracle_route", "SELECT route, count(*) AS n FROM (SELECT CASE WHEN cost % 2 = 0 THEN 'DETERMINISTIC' WHEN cost % 3 = 0 THEN 'RAG_LLM' ELSE 'HUMAN' END AS route FROM {a_cases}) x GROUP BY route")
def _(t):
    return t.a_cases.select(M.oracle_route({"DETERMINISTIC": c("cost") % 2 == 0, "RAG_LLM": c("cost") % 3 == 0}).alias("route")).groupBy("route").agg(one().alias("n"))


@query("m06_logistic_model")
def _(t):
    rows = t.a_cases.select("case_id", (c("cost") % 2).cast("double").alias("x1"), (c("cost") % 5 / 4.0).alias("x2"), (c("gold") == c("pred")).alias("y"))
    w, b = M.fit_logistic(rows, ["x1", "x2"], "y")
    return rows.select("case_id", F.round(M.logistic_score(w, b, ["x1", "x2"]), 9).alias("p"))


@query("m07_tree_model")
def _(t):
    rows = t.a_cases.select("case_id", (c("cost") % 7).cast("double").alias("x1"), (c("cost") % 5 / 4.0).alias("x2"), (c("gold") == c("pred")).alias("y"))
    return rows.select("case_id", F.round(M.tree_score(M.fit_tree(rows, ["x1", "x2"], "y")), 9).alias("p"))


@query("c36_rounding", "SELECT l_orderkey, l_linenumber, l_partkey, floor((l_quantity * l_discount - 1.5) * 100 + 0.5) / 100 AS r FROM {lineitem}")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", round_half_up(c("l_quantity") * c("l_discount") - 1.5).alias("r"))
