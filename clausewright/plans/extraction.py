"""Figures, rule atoms, taxonomy, anchoring, admission and judging as named queries.

Queries over literal wordings state the readings that are right as values; they share nothing with the engine's patterns.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import wording as W
from ..operators import disclosure as D
from ..operators import documents as X
from .registry import query

c = F.col


@query("c04_numbers_in_text", "SELECT id, value, percent FROM (VALUES (1, 12.5::DOUBLE, true), (1, 11.5, true), (2, -45.2, false), (2, 123456.5, false), (4, -3.5, false), (4, 2024.0, false), (4, 2150.0, false), (5, 12.0, false)) v(id, value, percent)")
def _(t):
    return t.fx_figures.select("id", F.explode(W.numbers_in(c("text"))).alias("x")).select("id", "x.value", "x.percent")


def _atoms(t):
    return t.fx_limits.select("id", "text", F.explode_outer(W.rule_atoms(c("text"))).alias("a"))


@query("c08_rule_atoms", """SELECT id, operator, value, unit, kind FROM (VALUES (1, '<=', 20::DOUBLE, '%', 'requirement'), (2, '>=', 9, '%', 'requirement'), (3, 'within_days', 30, 'working_days', 'requirement'),
(4, '<', 8, '%', 'condition'), (5, '<=', 50, '₹ lakh', 'condition'), (6, '<=', 50, '₹ lakh', 'requirement'), (7, '<=', 5, '%', 'requirement'), (7, '<=', 7, '%', 'requirement'), (8, '<=', 25, '%', 'requirement'),
(9, '>=', 4, '%', 'requirement'), (10, '>=', 5, '₹ crore', 'condition')) v(id, operator, value, unit, kind)""")
def _(t):
    return _atoms(t).where("a IS NOT NULL").select("id", "a.operator", "a.value", "a.unit", "a.kind")


@query("c09_variable_names", "SELECT id, name FROM (VALUES (1, 'single_counterparty_exposure'), (2, 'crar'), (7, 'gross_npa_ratio'), (8, 'htm_share'), (9, 'leverage_ratio')) v(id, name)")
def _(t):
    return _atoms(t).where("a IS NOT NULL").select("id", W.variable_name(c("a.variable"), c("text")).alias("name")).where("name IS NOT NULL").distinct()


@query("c10_subject_and_base", "SELECT id, variable, base FROM (VALUES (1, 'exposure to a single counterparty', 'Tier 1 capital'), (2, 'CRAR', NULL), (3, 'Complaints', 'receipt'), (4, 'ratio falls', NULL), (5, 'Loans', NULL), (6, 'Banks', NULL), (7, 'Gross NPA', 'advances respectively'), (8, 'Investments under HTM', 'total investments'), (9, 'leverage ratio', NULL), (10, 'Accounts', NULL)) v(id, variable, base)")
def _(t):
    return _atoms(t).where("a IS NOT NULL").select("id", "a.variable", "a.base").distinct()


@query("c28_requirement_taxonomy", """SELECT id, rule_type, risk, reading FROM (VALUES (1, 'A', 'high', false), (2, 'A', 'high', false), (3, 'D', 'medium', false), (4, 'A', 'low', false), (5, 'A', 'low', false), (6, 'A', 'low', false),
(7, 'A', 'high', false), (8, 'A', 'low', false), (9, 'A', 'high', false), (10, 'A', 'low', false), (11, 'E', 'low', true), (12, 'B', 'medium', false), (13, 'G', 'low', false), (14, 'F', 'medium', true), (15, 'E', 'low', true)) v(id, rule_type, risk, reading)""")
def _(t):
    kind = W.rule_type(c("text"), c("a.operator"), c("a.unit"), c("a.kind"), F.lit(None).cast("string"))
    return _atoms(t).select("id", "text", kind.alias("rule_type")).distinct().select("id", "rule_type", W.risk_level(F.lit(""), c("text")).alias("risk"), W.needs_reading(c("rule_type"), c("text")).alias("reading"))


_GAPS = "SELECT rule_id, bank_id, fy, quarter, value, operator, threshold, unit FROM {a_rules} JOIN {a_submissions} USING (rule_id) WHERE operator = '<=' AND value > threshold AND unit <> 'crore'"


@query("c30_recommendation", f"""
SELECT rule_id, bank_id, fy, quarter, concat('Reduce the figure from ', v, CASE unit WHEN '%' THEN '%' ELSE concat(' ', unit) END, ' to at most ', h, CASE unit WHEN '%' THEN '%' ELSE concat(' ', unit) END, ' (a gap of ', g, CASE unit WHEN '%' THEN ' percentage points' ELSE concat(' ', unit) END, ') and document the remediation plan for the Board.') AS said
FROM (SELECT *, CAST(CAST(value AS INT) AS VARCHAR) AS v, CAST(CAST(threshold AS INT) AS VARCHAR) AS h, CAST(CAST(value - threshold AS INT) AS VARCHAR) AS g FROM ({_GAPS}) x) y""")
def _(t):
    return t.sql(_GAPS).select("rule_id", "bank_id", "fy", "quarter", W.recommendation(F.lit("the figure"), c("value"), c("operator"), c("threshold"), c("unit"), F.lit("minimum")).alias("said"))


@query("c30_indian_grouping", "SELECT custkey, CASE WHEN b < 0 THEN '-' ELSE '' END || CASE WHEN w >= 10000000 THEN concat(w // 10000000, ',', lpad(CAST(w // 100000 % 100 AS VARCHAR), 2, '0'), ',', lpad(CAST(w // 1000 % 100 AS VARCHAR), 2, '0'), ',', lpad(CAST(w % 1000 AS VARCHAR), 3, '0')) WHEN w >= 100000 THEN concat(w // 100000, ',', lpad(CAST(w // 1000 % 100 AS VARCHAR), 2, '0'), ',', lpad(CAST(w % 1000 AS VARCHAR), 3, '0')) WHEN w >= 1000 THEN concat(w // 1000, ',', lpad(CAST(w % 1000 AS VARCHAR), 3, '0')) ELSE CAST(w AS VARCHAR) END AS shown FROM (SELECT c_custkey AS custkey, b, CAST(floor(abs(b)) AS BIGINT) AS w FROM (SELECT c_custkey, CAST(c_custkey * 7919 * (CASE c_custkey % 2 WHEN 0 THEN 1 ELSE -1 END) AS DOUBLE) AS b FROM {customer}) x) y")
def _(t):
    value = (c("c_custkey") * 7919 * F.when(c("c_custkey") % 2 == 0, 1).otherwise(-1)).cast("double")
    return t.customer.select(c("c_custkey").alias("custkey"), W.indian_number(value).alias("shown"))


@query("c24_excerpt", "SELECT id, said FROM (VALUES (2, 'A bank shall maintain a minimum CRAR of 9 per cent.'), (9, 'Minimum leverage ratio shall be 4 per cent.')) v(id, said)")
def _(t):
    return t.fx_limits.select("id", W.excerpt(c("text"), r"minimum").alias("said")).where("said IS NOT NULL")


@query("c20_abbreviations", "SELECT id, abbr FROM (VALUES (1, 'crar'), (1, 'nbfc'), (2, 'crar'), (3, 'lab'), (4, 'lcr')) v(id, abbr)")
def _(t):
    tokens = t.fx_asked.select("id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z0-9-]{1,9}"), F.lit(0))).alias("token"))
    fits = (c("token") == F.upper("token")) | (F.length("token") >= 4)
    return tokens.where(fits).join(F.broadcast(t.fx_glossary), F.lower("token") == c("abbr")).select("id", "abbr").distinct()


@query("c21_categories", "SELECT id, category FROM (VALUES (1, 'nbfc'), (3, 'lab'), (4, 'sfb')) v(id, category)")
def _(t):
    # Long names count as phrases, short ones only as tokens in capitals.
    named = t.spark.createDataFrame([("nbfc", "non banking financial company", "NBFC"), ("lab", "local area bank", "LAB"), ("sfb", "small finance bank", "SFB")], "category string, phrase string, token string")
    flat = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), r"s\b", ""), F.lit(" "))
    tokens = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z0-9-]*"), F.lit(0)), lambda w: F.regexp_replace(w, "s$", ""))
    asked = t.fx_asked.select("id", flat.alias("flat"), tokens.alias("tokens"))
    hit = c("flat").contains(F.concat(F.lit(" "), "phrase", F.lit(" "))) | F.array_contains(c("tokens"), c("token"))
    return asked.join(F.broadcast(named), hit).select("id", "category")


@query("c34_syllable_grade", "SELECT id, grade FROM (VALUES (11, round(0.39 * 3 / 1 + 11.8 * 4 / 3.0 - 15.59, 6)), (15, round(0.39 * 6 / 1 + 11.8 * 9 / 6.0 - 15.59, 6))) v(id, grade)")
def _(t):
    return t.fx_limits.where("id IN (11, 15)").select("id", F.round(W.reading_grade(c("text")), 6).alias("grade"))


@query("d03_figure_extraction", "SELECT metric, value, page, line FROM (VALUES ('crar', 14.25::DOUBLE, 1, 2), ('gross_npa_ratio', 3.1, 2, 1), ('net_npa_ratio', 0.9, 3, 2), ('net_worth', 1250.5, 3, 1)) v(metric, value, page, line)")
def _(t):
    return X.best_figures(X.figures(t.fx_lines, t.fx_metrics)).select("metric", "value", "page", "line")


@query("d03_candidates", "SELECT metric, page, line, value FROM (VALUES ('crar', 1, 2, 14.25::DOUBLE), ('gross_npa_ratio', 2, 1, 3.1), ('net_npa_ratio', 3, 2, 0.9), ('net_worth', 3, 1, 1250.5), ('net_worth', 4, 1, 200000.0)) v(metric, page, line, value)")
def _(t):
    return X.figures(t.fx_lines, t.fx_metrics).select("metric", "page", "line", "value")


@query("c44_d04_structured_figures", "SELECT name, metric, value FROM (VALUES ('CRAR', 'crar', 12.0::DOUBLE), ('GNPA', 'gross_npa_ratio', 3.0), ('Net NPA (%)', 'net_npa_ratio', 1.0), ('net_worth', 'net_worth', 50.0), ('CRAR of peers', NULL, 9.0), ('Net worth in lakh', 'net_worth', 2.0)) v(name, metric, value)")
def _(t):
    rows = t.spark.createDataFrame([("CRAR", 12.0, ""), ("GNPA", 3.0, ""), ("Net NPA (%)", 1.0, ""), ("net_worth", 50.0, "crore"), ("CRAR of peers", 9.0, ""), ("Net worth in lakh", 200.0, "lakh")], "name string, given double, given_unit string")
    found = X.aliased(rows, t.fx_metrics, "name").join(F.broadcast(t.fx_metrics.select("metric", "unit")), "metric", "left")
    return found.select("name", "metric", F.round(c("given") * F.when(c("unit") == "crore", X.amount_factor(c("given_unit"))).otherwise(1.0), 4).alias("value"))


@query("m10_rule_judge", "SELECT id, decision FROM (VALUES (1, 'COMPLIANT'), (2, 'AMBIGUOUS'), (3, 'NON_COMPLIANT'), (4, 'COMPLIANT'), (5, 'NON_COMPLIANT'), (6, 'AMBIGUOUS'), (7, 'AMBIGUOUS'), (8, 'INSUFFICIENT_DATA'), (9, 'COMPLIANT'), (10, 'INSUFFICIENT_DATA')) v(id, decision)")
def _(t):
    return t.fx_evidence.select("id", W.judge(c("clause"), c("evidence"), c("relevant")).alias("decision"))


# --- admission and rebuilding ------------------------------------------------------------------------------------


@query("s12_admission", """
SELECT doc_id, format, CASE WHEN format IS NULL THEN 415 WHEN format = 'pdf' AND scanned THEN 422 WHEN length(trim(coalesce(text, ''))) < 20 THEN 422 ELSE 200 END AS status
FROM (SELECT *, CASE WHEN file_name LIKE '%.pdf' THEN 'pdf' WHEN file_name LIKE '%.XLSX' THEN 'xlsx' WHEN file_name LIKE '%.csv' OR file_name LIKE '%.tsv' THEN 'csv' WHEN file_name LIKE '%.md' THEN 'txt' WHEN file_name LIKE '%.html' THEN 'html' WHEN file_name LIKE '%.json' THEN 'json' END AS format FROM {a_files}) x""")
def _(t):
    return t.a_files.select("doc_id", X.file_format(c("file_name")).alias("format"), X.admission(c("file_name"), c("scanned"), c("text")).alias("status"))


@query("f13_usable_candidates", r"SELECT rule_id FROM {a_rules} WHERE unit = '%' AND operator IN ('>=', '<=', '>', '<') AND atom_kind = 'requirement' AND length(variable_text) >= 4 AND NOT regexp_matches(concat(variable_text, ' ', brand), '(?i)\byes\s*/\s*no\b|\bstatus\b|\||green')")
def _(t):
    fragment = F.concat_ws(" ", "variable_text", "brand").rlike(r"(?i)\byes\s*/\s*no\b|\bstatus\b|\||green")
    return t.a_rules.where((c("unit") == "%") & c("operator").isin(">=", "<=", ">", "<") & (c("atom_kind") == "requirement") & (F.length("variable_text") >= 4) & ~fragment).select("rule_id")


@query("f14_version_gate", "SELECT 2.5::DOUBLE AS version, count(*) AS n FROM {a_rules}")
def _(t):
    version = X.require_version(t.spark.createDataFrame([("extraction_version", "2.5"), ("built", "today")], "key string, value string"))
    return t.a_rules.agg(F.lit(version).alias("version"), F.count(F.lit(1)).alias("n"))


@query("u10_carried_columns", "SELECT bank_id, rule, value FROM {a_history} h WHERE rule = 'error'")
def _(t):
    old, new = t.a_history.withColumnRenamed("submitted_at", "sent_at").drop("event_id"), t.a_history
    return t.a_history.where("rule = 'error'").select(*X.carried_columns(old, new))


@query("o07_length_batches", "SELECT doc_id, (row_number() OVER (ORDER BY length(coalesce(text, '')) DESC, doc_id) - 1) // 32 AS batch FROM {documents}")
def _(t):
    return X.length_batches(t.documents.select("doc_id", "text"), F.length(F.coalesce("text", F.lit(""))), "doc_id").select("doc_id", "batch")


@query("j18_current_vectors", "SELECT vec_id FROM {a_vectors} WHERE doc_id IS NOT NULL AND stored_hash = md5(text)")
def _(t):
    return t.a_vectors.where(c("stored_hash") == F.md5("text")).select("vec_id")


@query("s14_vector_integrity", "SELECT vec_id, coalesce(stored_hash = md5(text), false) AND len(embedding) = 64 AS usable FROM {a_vectors}")
def _(t):
    return t.a_vectors.select("vec_id", (F.coalesce(c("stored_hash") == F.md5("text"), F.lit(False)) & (F.size("embedding") == 64)).alias("usable"))


# --- anchoring ---------------------------------------------------------------------------------------------------

_CATALOG = [("licence", "src.*", "licensed under"), ("gnu", "src1.*", "gnu general"), ("ratio", "src.*", "capital adequacy ratio"), ("contact", "src[0-9]$", "@[a-z]+"), ("thing", "src.*", "(the|of) [a-z]+ing")]
_CATALOG_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', '{x}')" for a, b, x in _CATALOG) + ") r(rule, d, x)"


def _anchored(t):
    rules = t.spark.createDataFrame(_CATALOG, "rule string, document_pattern string, text_pattern string")
    return X.anchored(t.documents.select("source", "doc_id", "text"), rules, "source", ["doc_id"], "text")


@query("j17_w08_rule_anchors", f"SELECT r.rule, x.doc_id IS NOT NULL AS verified, x.source AS document, x.doc_id FROM {_CATALOG_SQL} LEFT JOIN (SELECT rule, source, doc_id FROM {_CATALOG_SQL} JOIN {{documents}} ON regexp_matches(source, r.d) AND regexp_matches(text, concat('(?i)', r.x)) QUALIFY row_number() OVER (PARTITION BY rule ORDER BY source, doc_id) = 1) x USING (rule)")
def _(t):
    return _anchored(t)


@query("j26_item_anchors", f"SELECT rule, source AS document, doc_id FROM {_CATALOG_SQL} JOIN {{documents}} ON regexp_matches(source, r.d) AND regexp_matches(text, concat('(?i)', r.x)) QUALIFY row_number() OVER (PARTITION BY rule ORDER BY source, doc_id) = 1")
def _(t):
    return _anchored(t).where("verified").select("rule", "document", "doc_id")


@query("w17_numbering_scopes", "SELECT clause_id, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY seq) AS BIGINT) AS scope FROM (SELECT *, CASE WHEN n - lag(n) OVER (PARTITION BY doc_id ORDER BY seq) BETWEEN 1 AND 6 THEN 0 ELSE 1 END AS new FROM (SELECT clause_id, doc_id, seq, text_length % 12 AS n FROM {a_clauses}) x) y")
def _(t):
    return X.numbered_scopes(t.a_clauses.withColumn("n", c("text_length") % 12), "doc_id", ["seq"], "n").select("clause_id", "scope")


@query("w11_best_passage", "SELECT user_id, max_by(event_id, (value, -event_id)) AS passage, max(value) AS score FROM {events} GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -c("event_id"))).alias("passage"), F.max("value").alias("score"))


@query("k02_block_windows", "SELECT doc_id, i, substr(text, CAST(i * 1200 + 1 AS INT), 1400) AS piece FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(greatest(length(text) - 1400, 0) / 1200.0) AS BIGINT) + 1)) AS i FROM {documents} WHERE n_chars > 1400) x")
def _(t):
    from ..operators.retrieval import sliding_windows

    return sliding_windows(t.documents.where("n_chars > 1400"), "doc_id", "text", 1400, 200)


# --- checks on evidence and networks -----------------------------------------------------------------------------


@query("d13_qualitative_check", """
SELECT query_id, CASE WHEN n = 0 THEN 'LIKELY_GAP' WHEN score >= 0.9 THEN 'COVERED' WHEN score >= 0.6 THEN 'PARTIAL' ELSE 'LIKELY_GAP' END AS status, CASE WHEN score >= 0.6 THEN vec_id END AS evidence
FROM (SELECT o.vec_id AS query_id, e.vec_id, round(list_dot_product(CAST(o.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS score, count(*) OVER (PARTITION BY o.vec_id) AS n FROM {embeddings} o JOIN {embeddings} e ON o.vec_id <> e.vec_id WHERE o.vec_id % 100 = 0 AND e.label < 5
QUALIFY row_number() OVER (PARTITION BY o.vec_id ORDER BY round(list_dot_product(CAST(o.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) DESC, e.vec_id) = 1) x""")
def _(t):
    from ..operators.retrieval import vector_top_k

    asked = t.embeddings.where("vec_id % 100 = 0")
    best = asked.select(c("vec_id").alias("query_id")).join(vector_top_k(asked, t.embeddings.where("label < 5"), 1), "query_id", "left")
    status = F.when(c("score") >= 0.9, "COVERED").when(c("score") >= 0.6, "PARTIAL").otherwise("LIKELY_GAP")
    return best.select("query_id", status.alias("status"), F.when(c("score") >= 0.6, c("vec_id")).alias("evidence"))


_CAPITAL = "SELECT c_custkey AS bank, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS tier1, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal / 2 END AS tier2, c_acctbal * 2 AS owned, c_acctbal + 1 AS paid_up, CASE c_custkey % 6 WHEN 0 THEN 'tier1' WHEN 1 THEN 'capital_funds' WHEN 2 THEN 'owned_funds' WHEN 3 THEN 'paid_up_capital_reserves' WHEN 4 THEN 'capital_fund_rcb' ELSE 'other' END AS base FROM {customer}"


@query("g11_capital_base", f"SELECT bank, CASE WHEN base = 'tier1' THEN tier1 WHEN base = 'capital_funds' THEN tier1 + coalesce(tier2, 0) WHEN base = 'owned_funds' THEN owned WHEN base IN ('paid_up_capital_reserves', 'capital_fund_rcb') THEN paid_up END AS amount FROM ({_CAPITAL}) x")
def _(t):
    from ..operators.graph import capital_base

    return t.sql(_CAPITAL).select("bank", capital_base(c("base"), c("tier1"), c("tier2"), c("owned"), c("paid_up")).alias("amount"))


@query("u04_provisional_groups", "WITH p AS (SELECT user_id, list(event_id ORDER BY event_id) AS members FROM {events} GROUP BY user_id), f AS (SELECT user_id, list(event_id ORDER BY event_id) AS members FROM {events} WHERE event_type <> 'error' GROUP BY user_id) SELECT user_id, len(members) AS n FROM p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.members = p.members)")
def _(t):
    from ..operators.graph import provisional_only

    groups = lambda rows: rows.groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("members"))
    return provisional_only(groups(t.events), groups(t.events.where("event_type <> 'error'"))).select("user_id", F.size("members").cast("long").alias("n"))


_PARTIES = "SELECT c_custkey AS party, c_acctbal AS exposure, c_custkey % 2 + 2 AS hops, c_custkey % 11 <> 0 AS verified, c_custkey % 5 = 0 AS flagged_only, CASE WHEN c_custkey % 7 = 0 THEN 'staff' END AS exception FROM {customer} UNION ALL SELECT c_custkey, c_acctbal, 1, c_custkey % 11 <> 0, true, CASE WHEN c_custkey % 7 = 0 THEN 'staff' END FROM {customer} WHERE c_custkey % 3 = 0"


@query("g17_related_party_verdicts", f"SELECT party, CASE WHEN NOT bool_and(verified) THEN 'NEEDS_REVIEW' WHEN bool_and(flagged_only) THEN 'NEEDS_REVIEW' WHEN max(exception) IS NOT NULL THEN 'NEEDS_REVIEW' ELSE 'PROHIBITED' END AS status, bool_and(flagged_only) AS provisional, CAST(coalesce(min(hops) FILTER (NOT flagged_only), min(hops)) AS BIGINT) AS hops FROM ({_PARTIES}) x WHERE exposure > 0 GROUP BY party")
def _(t):
    from ..operators.graph import related_party_verdicts

    return related_party_verdicts(t.sql(_PARTIES)).select("party", "status", "provisional", c("hops").cast("long").alias("hops"))


@query("d06_tiers_and_glide_path", """
SELECT bank, CASE WHEN value >= target THEN 'PASS' WHEN value >= glide THEN 'ON_GLIDE_PATH' ELSE 'BREACH' END AS status FROM (
  SELECT c_custkey AS bank, CAST(c_custkey % 16 AS DOUBLE) AS value, CASE WHEN c_acctbal < 1000 THEN 9.0 WHEN c_acctbal < 5000 THEN 11.0 ELSE 12.0 END AS target,
         CASE WHEN c_custkey % 3 = 0 THEN 8.0 WHEN c_custkey % 3 = 1 THEN 9.0 ELSE 99.0 END AS glide FROM {customer}) x""")
def _(t):
    tier = D.tier_threshold(c("c_acctbal"), [(1000, 9.0), (5000, 11.0)], 12.0)
    glide = D.glide_threshold(c("c_custkey") % 3, [(0, 8.0), (1, 9.0)], 99.0)
    return t.customer.select(c("c_custkey").alias("bank"), D.tiered_status((c("c_custkey") % 16).cast("double"), tier, glide).alias("status"))
