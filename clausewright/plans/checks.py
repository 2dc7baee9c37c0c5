"""Disclosure checks, related parties, features and taxonomy as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers as N
from ..functions import text as X
from ..operators import disclosure as D
from ..operators import graph as G
from ..operators import retrieval as T
from .registry import query

c = F.col
_LEVEL = "CASE rule_id % 3 WHEN 0 THEN 'minimum' WHEN 1 THEN 'buffer' ELSE 'target' END"
_CMP = "CASE WHEN operator IN ('<=','within_days') THEN value <= threshold WHEN operator = '>=' THEN value >= threshold WHEN operator = '<' THEN value < threshold WHEN operator = '>' THEN value > threshold ELSE false END"
_D06 = f"SELECT rule_id, bank_id, fy, quarter, value, confidence, CASE WHEN {_CMP} THEN 'PASS' WHEN {_LEVEL} = 'minimum' THEN 'BREACH' WHEN {_LEVEL} = 'buffer' THEN 'BUFFER_SHORTFALL' ELSE 'TARGET_SHORTFALL' END AS status FROM {{a_rules}} JOIN {{a_submissions}} USING (rule_id)"


def _levels(t, kind="inner"):
    level = N.chain([(c("rule_id") % 3 == 0, F.lit("minimum")), (c("rule_id") % 3 == 1, F.lit("buffer"))], F.lit("target"))
    return t.a_rules.join(t.a_submissions, "rule_id", kind).withColumn("status", D.evaluate_level(c("value"), c("operator"), c("threshold"), level))


@query("d06_rule_levels", f"SELECT rule_id, bank_id, fy, quarter, status FROM ({_D06}) x")
def _(t):
    return _levels(t).select("rule_id", "bank_id", "fy", "quarter", "status")


@query("d07_disclosed_status", f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN rule_id % 10 = 0 THEN 'NEEDS_REVIEW' WHEN value IS NULL THEN 'NOT_DISCLOSED' WHEN status <> 'PASS' AND confidence = 'low' THEN 'NEEDS_REVIEW' ELSE status END AS status FROM ({_D06.replace('JOIN', 'LEFT JOIN')}) x) y GROUP BY status")
def _(t):
    status = D.disclosed_status(c("value"), c("rule_id") % 10 != 0, c("confidence"), c("status"))
    return _levels(t, "left").select(status.alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("d08_rule_discovery", "SELECT rule_id, score FROM (SELECT rule_id, score, row_number() OVER (PARTITION BY clause_id, operator, threshold ORDER BY score DESC, rule_id) AS rn FROM (SELECT *, CASE WHEN contains(lower(variable_text), 'ring') THEN 3 ELSE 0 END + CASE WHEN contains(lower(brand), 'ring') THEN 1 ELSE 0 END + CASE WHEN atom_kind = 'requirement' THEN 1 ELSE 0 END AS score FROM {a_rules} WHERE contains(lower(variable_text), 'ring') OR contains(lower(brand), 'ring')) x) y WHERE rn = 1 ORDER BY score DESC, rule_id LIMIT 3")
def _(t):
    return D.discover_rules(t.a_rules, "ring")


@query("d09_completeness", "SELECT i.item, min(d.doc_id) AS first, CASE WHEN min(d.doc_id) IS NULL THEN 'LIKELY_MISSING' ELSE 'PRESENT' END AS status FROM (VALUES ('licence', 'Licensed under'), ('licence_gnu', 'GNU General'), ('capital', 'capital adequacy')) i(item, pattern) LEFT JOIN {documents} d ON contains(d.text, i.pattern) GROUP BY i.item")
def _(t):
    items = t.spark.createDataFrame([("licence", "Licensed under"), ("licence_gnu", "GNU General"), ("capital", "capital adequacy")], "item string, pattern string")
    return D.completeness(t.documents.select("doc_id", "text"), items, "doc_id", "text")


@query("d12_match_by_name", "SELECT a.doc_id, b.s_suppkey FROM {a_documents} a JOIN {supplier} b ON regexp_replace(lower(concat(a.title, '!')), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(b.s_name), '[^a-z0-9]+', '', 'g')")
def _(t):
    return D.match_by_name(t.a_documents.withColumn("title", F.concat("title", F.lit("!"))), t.supplier, "title", "s_name").select("doc_id", "s_suppkey")


@query("d14_quoted_figures", r"SELECT clause_id, contains(lower(regexp_replace(text, '\s+', '', 'g')), lower(regexp_replace(substr(text, 3, 30), '\s+', '', 'g'))) AND contains(substr(text, 3, 30), '20') AS accepted FROM {fx_clauses}")
def _(t):
    return t.fx_clauses.select("clause_id", D.quoted(c("text"), F.substring("text", 3, 30), F.lit("20")).alias("accepted"))


@query("d15_schedules", "SELECT CAST(1 AS INT) AS rule, CAST(d AS DATE) AS since, CAST(v AS DOUBLE) AS value FROM (VALUES ('2021-04-01', 8.0), ('2022-04-01', 8.5), ('2023-04-01', 9.0)) x(d, v)")
def _(t):
    said = "The ratio is 8 per cent from 2021-04-01, 8.5 per cent from 2022-04-01, 9 per cent from 2023-04-01."
    return D.schedules(t.spark.createDataFrame([(1, said)], "rule int, text string"), "rule", "text")


@query("w07_best_candidate", "SELECT rule, value, agree FROM (SELECT rule, value, count(*) OVER (PARTITION BY rule, value) AS agree, row_number() OVER (PARTITION BY rule ORDER BY bank_id DESC, event_id, value) AS rn FROM {a_history}) x WHERE rn = 1")
def _(t):
    return D.best_candidates(t.a_history, ["rule"], "value", "bank_id", "event_id").select("rule", "value", "agree")


_SIM = "round(list_dot_product(CAST(o.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9)"


@query("j11_best_evidence", f"SELECT query_id, vec_id, score, CASE WHEN score >= 0.6 THEN 'EVIDENCE_FOUND' ELSE 'LIKELY_GAP' END AS status FROM (SELECT o.vec_id AS query_id, e.vec_id, {_SIM} AS score, row_number() OVER (PARTITION BY o.vec_id ORDER BY {_SIM} DESC, e.vec_id) AS rn FROM {{embeddings}} o JOIN {{embeddings}} e ON o.vec_id <> e.vec_id WHERE o.vec_id % 50 = 0 AND e.label < 5) x WHERE rn = 1")
def _(t):
    best = T.vector_top_k(t.embeddings.where("vec_id % 50 = 0"), t.embeddings.where("label < 5"), 1)
    return best.withColumn("status", F.when(c("score") >= 0.6, "EVIDENCE_FOUND").otherwise("LIKELY_GAP"))


@query("j12_two_best", f"SELECT query_id, list(score ORDER BY score DESC) AS scores FROM (SELECT o.vec_id AS query_id, {_SIM} AS score, row_number() OVER (PARTITION BY o.vec_id ORDER BY {_SIM} DESC, e.vec_id) AS rn FROM {{embeddings}} o JOIN {{embeddings}} e ON o.vec_id <> e.vec_id WHERE o.vec_id % 100 = 0) x WHERE rn <= 2 GROUP BY query_id")
def _(t):
    best = T.vector_top_k(t.embeddings.where("vec_id % 100 = 0"), t.embeddings, 2)
    return best.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"))


_HELD = "((edge_type = 'OWNS' AND pct >= 20) OR edge_type = 'DIRECTOR_OF')"


@query("g09_restricted_parties", f"""
SELECT entity_id, arg_min(reason, hops * 100 + ascii(reason)) AS reason, min(hops) AS hops FROM (
  WITH first AS (SELECT from_entity AS p, CASE WHEN edge_type = 'DIRECTOR_OF' THEN 'director' ELSE 'holder' END AS reason, 1 AS hops FROM {{a_edges}} WHERE to_entity % 10 = 0 AND to_entity = 100 AND (edge_type = 'DIRECTOR_OF' OR (edge_type = 'OWNS' AND pct >= 10))),
  kin AS (SELECT from_entity AS a, to_entity AS b FROM {{a_edges}} WHERE edge_type = 'RELATIVE_OF' UNION ALL SELECT to_entity, from_entity FROM {{a_edges}} WHERE edge_type = 'RELATIVE_OF'),
  persons AS (SELECT * FROM first UNION ALL SELECT kin.b, 'relative', 2 FROM first JOIN kin ON kin.a = first.p)
  SELECT p AS entity_id, reason, hops FROM persons UNION ALL SELECT e.to_entity, 'firm', hops + 1 FROM persons JOIN {{a_edges}} e ON e.from_entity = persons.p WHERE {_HELD}) x WHERE entity_id <> 100 GROUP BY entity_id""")
def _(t):
    return G.restricted_parties(t.a_edges, t.a_entities, 100)


@query("g16_intra_group_single", "SELECT x.entity_id, sum(amount) AS total FROM {a_exposures} x JOIN {a_edges} e ON e.from_entity = 10 AND e.to_entity = x.entity_id GROUP BY x.entity_id")
def _(t):
    own = t.a_edges.where("from_entity = 10").select(c("to_entity").alias("entity_id"))
    return t.a_exposures.join(own, "entity_id").groupBy("entity_id").agg(F.sum("amount").alias("total"))


@query("m01_features", "SELECT case_id, (rule_type = 'de')::INT AS type_de, (rule_type = 'en')::INT AS type_en, round(least(greatest(cost / CAST(5000 AS DOUBLE), 0), 1), 9) AS confidence, round((toxic + 1) / CAST(3 AS DOUBLE), 9) AS risk, (cost % 2 = 0)::INT AS conflict FROM {a_cases}")
def _(t):
    return t.a_cases.select("case_id", *[(c("rule_type") == k).cast("int").alias(f"type_{k}") for k in ("de", "en")], F.round(F.least(F.greatest(c("cost") / 5000.0, F.lit(0.0)), F.lit(1.0)), 9).alias("confidence"), F.round((c("toxic") + 1) / 3.0, 9).alias("risk"), (c("cost") % 2 == 0).cast("int").alias("conflict"))


@query("m13_generated_cases", "SELECT rule_id, kind, CAST(concat('0x', substr(sha1(concat(CAST(rule_id AS STRING), ':', kind)), 1, 8)) AS BIGINT) % 100 AS value FROM {a_rules} JOIN (VALUES ('compliant'), ('non_compliant'), ('boundary'), ('near_boundary'), ('missing_data'), ('adversarial'), ('contradictory'), ('ambiguous'), ('cross_version')) k(kind) ON true")
def _(t):
    kinds = F.array(*map(F.lit, ("compliant", "non_compliant", "boundary", "near_boundary", "missing_data", "adversarial", "contradictory", "ambiguous", "cross_version")))
    rows = t.a_rules.select("rule_id", F.explode(kinds).alias("kind"))
    drawn = F.conv(F.substring(F.sha1(F.concat(c("rule_id").cast("string"), F.lit(":"), "kind")), 1, 8), 16, 10).cast("long") % 100
    return rows.withColumn("value", drawn)


@query("r08_extractive_answer")
def _(t):
    parts = t.a_chunks.select("chunk_id", F.posexplode(X.sentences(c("text"))).alias("i", "s"))
    score = F.size(F.filter(T.terms(c("s")), lambda w: w.isin("the", "tion", "ing"))) + F.when(c("s").rlike("[0-9]"), 1.5).otherwise(0.0) + F.when(c("s").rlike(r"(?i)\b(?:shall|must|may)\b"), 0.5).otherwise(0.0)
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy(c("score").desc(), "i"))
    best = parts.withColumn("score", score).withColumn("r", rank).where("r <= 2")
    return best.groupBy("chunk_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), " ").alias("answer"))


@query("c31_confidence_band", "SELECT vec_id, CASE WHEN label >= 7 AND vec_id % 2 = 0 THEN 'high' WHEN label >= 6 OR vec_id % 2 = 0 THEN 'medium' ELSE 'low' END AS band FROM {embeddings}")
def _(t):
    return t.embeddings.select("vec_id", T.confidence_band((c("label") + 0.5) / 10.0, F.when(c("vec_id") % 2 == 0, 0.5).otherwise(0.0)).alias("band"))


@query("c38_key_value", "SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS value FROM {events} WHERE json_extract_string(props, '$.k') IS NOT NULL")
def _(t):
    lines = F.regexp_replace("props", r'[{}"]', "")
    return t.events.select("event_id", F.explode(F.str_to_map(lines, F.lit(","), F.lit(r":\s*"))).alias("name", "value")).select("event_id", F.trim("name").alias("name"), F.trim("value").alias("value"))


@query("c18_glossary", r"SELECT id, regexp_extract(x, '\(([A-Z]{2,})\)', 1) AS abbr FROM (VALUES (1, 'Capital Adequacy Ratio (CAR) applies'), (2, 'Know Your Customer (KYC)'), (3, 'Other Words (XYZ)')) v(id, x) WHERE id < 3")
def _(t):
    rows = t.spark.createDataFrame([(1, "Capital Adequacy Ratio (CAR) applies"), (2, "Know Your Customer (KYC)"), (3, "Other Words (XYZ)")], "id int, x string")
    abbr, words = F.regexp_extract("x", r"\(([A-Z]{2,})\)", 1), F.split(F.trim(F.regexp_extract("x", r"^(.*?)\s*\([A-Z]{2,}\)", 1)), " ")
    initials = F.array_join(F.transform(F.slice(words, F.greatest(F.size(words) - F.length(abbr) + 1, F.lit(1)), F.length(abbr)), lambda w: F.upper(F.substring(w, 1, 1))), "")
    return rows.withColumn("abbr", abbr).where(initials == c("abbr")).select("id", "abbr")


@query("o03_coverage_rerank", "SELECT chunk_id, row_number() OVER (ORDER BY cover DESC, chunk_id) AS place FROM (SELECT chunk_id, contains(lower(text), 'ing')::INT + contains(lower(text), 'zzz')::INT + contains(text, '@')::INT AS cover FROM {a_chunks}) x QUALIFY place <= 25")
def _(t):
    cover = T.coverage(c("text"), F.array(*map(F.lit, ("ing", "zzz", "@"))))
    top = t.a_chunks.select("chunk_id", cover.alias("cover")).orderBy(c("cover").desc(), "chunk_id").limit(25)
    return top.select("chunk_id", F.row_number().over(Window.orderBy(c("cover").desc(), "chunk_id")).alias("place"))


@query("u03_subsumed_sets", "SELECT a.brand FROM (SELECT brand, list(DISTINCT operator) AS s FROM {a_rules} GROUP BY brand) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT brand, list(DISTINCT operator) AS s FROM {a_rules} GROUP BY brand) b WHERE b.brand <> a.brand AND list_has_all(b.s, a.s) AND (len(b.s) > len(a.s) OR b.brand < a.brand))")
def _(t):
    sets = t.a_rules.select(c("brand").alias("root"), c("operator").alias("member")).distinct()
    return G.numbered_groups(sets).select(c("root").alias("brand"))
