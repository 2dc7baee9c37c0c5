"""Joins, filters, aggregations, windows, sorts and set operations as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import SEVERITY, compare, decision, severity
from ..operators import rules as R
from .registry import query

c = F.col

# --- rule checks -----------------------------------------------------------------------------------------------

_CMP = "CASE WHEN operator IN ('<=','within_days') THEN value <= threshold WHEN operator = '>=' THEN value >= threshold WHEN operator = '<' THEN value < threshold WHEN operator = '>' THEN value > threshold ELSE false END"
_CHECK = f"""
SELECT r.rule_id, s.bank_id, s.fy, s.quarter, CASE WHEN value IS NULL THEN 'NOT_REPORTED' WHEN {_CMP} THEN 'PASS' ELSE 'BREACH' END AS status
FROM {{a_rules}} r LEFT JOIN {{a_submissions}} s ON r.rule_id = s.rule_id WHERE r.atom_kind = 'requirement'"""
_DECIDE = "CASE status WHEN 'PASS' THEN 'COMPLIANT' WHEN 'BREACH' THEN 'NON_COMPLIANT' ELSE 'INSUFFICIENT_DATA' END"


@query("d01_quantitative_check", f"SELECT bank_id, status, {_DECIDE} AS decision, count(*) AS n FROM ({_CHECK}) x GROUP BY ALL")
def _(t):
    checked = R.check_rules(t.a_rules, t.a_submissions, ["bank_id", "fy", "quarter"])
    return checked.groupBy("bank_id", "status", "decision").agg(F.count(F.lit(1)).alias("n"))


@query("d01_check_rows", f"SELECT rule_id, bank_id, fy, quarter, status FROM ({_CHECK}) x")
def _(t):
    return R.check_rules(t.a_rules, t.a_submissions, ["bank_id", "fy", "quarter"]).select("rule_id", "bank_id", "fy", "quarter", "status")


@query("d02_quick_check", f"""
SELECT rule_id, CASE WHEN value IS NULL THEN 'SKIPPED' WHEN {_CMP} THEN 'PASS' ELSE 'VIOLATION' END AS status
FROM (SELECT r.rule_id, r.operator, r.threshold, v.value FROM {{a_rules}} r LEFT JOIN
  (SELECT lower(p_name) AS k, avg(CAST(p_size AS DOUBLE)) AS value FROM {{part}} WHERE p_size > 10 GROUP BY 1) v ON trim(regexp_replace(lower(variable_text), '[^a-z0-9]+', ' ', 'g')) = v.k) x""")
def _(t):
    given = t.part.where("p_size > 10").groupBy(F.lower("p_name").alias("k")).agg(F.avg(c("p_size").cast("double")).alias("value"))
    keyed = t.a_rules.withColumn("k", F.trim(F.regexp_replace(F.lower("variable_text"), "[^a-z0-9]+", " ")))
    verdict = F.when(c("value").isNull(), "SKIPPED").when(compare(c("value"), c("operator"), c("threshold")), "PASS").otherwise("VIOLATION")
    return keyed.join(given, "k", "left").select("rule_id", verdict.alias("status"))


@query("j10_asof_version", """
SELECT h.event_id, h.rule, h.value, v.effective_from, v.threshold
FROM (SELECT event_id, rule, value, CAST(submitted_at AS DATE) AS day FROM {a_history}) h ASOF LEFT JOIN {a_versions} v ON h.rule = v.rule AND h.day >= v.effective_from""")
def _(t):
    facts = t.a_history.select("event_id", "rule", "value", c("submitted_at").cast("date").alias("day"))
    return R.version_in_force(facts, t.a_versions, "rule", "day", "effective_from", "threshold").select("event_id", "rule", "value", "effective_from", "threshold")


@query("m09_versioned_verdict", """
SELECT rule, CASE WHEN threshold IS NULL THEN 'INSUFFICIENT_DATA' WHEN value <= threshold THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END AS decision, count(*) AS n
FROM (SELECT h.rule, h.value, v.threshold FROM (SELECT *, CAST(submitted_at AS DATE) AS day FROM {a_history}) h ASOF LEFT JOIN {a_versions} v ON h.rule = v.rule AND h.day >= v.effective_from) x GROUP BY ALL""")
def _(t):
    facts = t.a_history.select("rule", "value", c("submitted_at").cast("date").alias("day"))
    found = R.version_in_force(facts, t.a_versions, "rule", "day", "effective_from", "threshold")
    verdict = F.when(c("threshold").isNull(), "INSUFFICIENT_DATA").when(c("value") <= c("threshold"), "COMPLIANT").otherwise("NON_COMPLIANT")
    return found.groupBy("rule", verdict.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query("a14_trend_anomaly", """
SELECT event_id, n, CASE WHEN n < 2 THEN 'none' WHEN dev = 0 THEN CASE WHEN value <> mean THEN 'first_change' ELSE 'none' END WHEN abs((value - mean) / dev) > 3 THEN 'jump' ELSE 'none' END AS flag
FROM (SELECT event_id, value, count(value) OVER w AS n, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS dev FROM {a_history}
      WINDOW w AS (PARTITION BY bank_id, rule ORDER BY submitted_at, event_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) x""")
def _(t):
    return R.trend_anomalies(t.a_history, ["bank_id", "rule"], [c("submitted_at"), c("event_id")], "value").select("event_id", "n", "flag")


# --- filters ---------------------------------------------------------------------------------------------------


@query("f01_category_documents", "SELECT doc_id, title FROM {a_documents} WHERE doc_id IN (SELECT doc_id FROM {a_doc_categories} WHERE category = 2)")
def _(t):
    return t.a_documents.join(t.a_doc_categories.where("category = 2"), "doc_id", "left_semi").select("doc_id", "title")


@query("f02_rule_search", "SELECT rule_id, operator, unit FROM {a_rules} WHERE atom_kind = 'requirement' AND unit = '%' AND (variable_text ILIKE '%RED%' OR brand ILIKE '%RED%')")
def _(t):
    wanted = [c("atom_kind") == "requirement", c("unit") == "%", c("variable_text").ilike("%RED%") | c("brand").ilike("%RED%")]
    found = t.a_rules
    for condition in wanted:
        found = found.where(condition)
    return found.select("rule_id", "operator", "unit")


@query("f03_document_search", "SELECT doc_id, title FROM {a_documents} WHERE title ILIKE '%SUPPLIER#00000001%' OR label ILIKE 'V1'")
def _(t):
    return t.a_documents.where(c("title").ilike("%SUPPLIER#00000001%") | c("label").ilike("V1")).select("doc_id", "title")


@query("f04_clauses_in_order", "SELECT clause_id, seq FROM {a_clauses} WHERE doc_id = 7 AND role = 'obligation' ORDER BY seq LIMIT 50")
def _(t):
    return t.a_clauses.where("doc_id = 7 AND role = 'obligation'").orderBy("seq").limit(50).select("clause_id", "seq")


@query("f05_obligations", "SELECT clause_id FROM {a_clauses} WHERE role = 'obligation' AND ctype IN ('qualitative', 'relational') AND text_length BETWEEN 80 AND 4000")
def _(t):
    return t.a_clauses.where((c("role") == "obligation") & c("ctype").isin("qualitative", "relational") & c("text_length").between(80, 4000)).select("clause_id")


_TAGS = "SELECT doc_id, concat('[\"c', CAST(category AS STRING), '\",\"t', CAST(topic AS STRING), '\"]') AS tags FROM {a_documents}"


@query("f06_array_member", f"SELECT doc_id FROM ({_TAGS}) x WHERE tags LIKE '%\"t3\"%'")
def _(t):
    return t.sql(_TAGS).where(F.array_contains(F.from_json("tags", "array<string>"), "t3")).select("doc_id")


@query("f07_json_path", """SELECT event_id, coalesce(json_extract_string(props, '$.mode'), 'fixed') AS mode, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM {events}""")
def _(t):
    return t.events.select("event_id", F.coalesce(F.get_json_object("props", "$.mode"), F.lit("fixed")).alias("mode"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("f08_changed_label", "SELECT d.doc_id FROM {a_documents} d LEFT JOIN {a_documents} e ON e.doc_id = d.doc_id + 1 WHERE coalesce(d.label, '') IS DISTINCT FROM coalesce(e.label, '')")
def _(t):
    other = t.a_documents.select((c("doc_id") - 1).alias("doc_id"), c("label").alias("other"))
    return t.a_documents.join(other, "doc_id", "left").where(F.coalesce("label", F.lit("")) != F.coalesce("other", F.lit(""))).select("doc_id")


@query("f09_confidence_override", "SELECT c.clause_id, coalesce(r.confidence, 'clause') AS confidence FROM {a_clauses} c LEFT JOIN {a_rules} r ON r.clause_id = c.clause_id")
def _(t):
    return t.a_clauses.join(t.a_rules.select("clause_id", "rule_id", "confidence"), "clause_id", "left").select("clause_id", F.when(c("rule_id").isNotNull() & c("confidence").isNotNull(), c("confidence")).otherwise("clause").alias("confidence"))


@query("f10_prefix", "SELECT chunk_id, substr(text, 1, 400) AS head FROM {a_chunks}")
def _(t):
    return t.a_chunks.select("chunk_id", F.substring("text", 1, 400).alias("head"))


@query("f11_edge_status", "SELECT from_entity, to_entity, edge_type FROM {a_edges} WHERE status = 'confirmed'")
def _(t):
    return confirmed(t.a_edges).select("from_entity", "to_entity", "edge_type")


def confirmed(edges, include_flagged: bool = False):
    return edges.where((c("status") != "rebutted") & ((c("status") != "flagged") | F.lit(include_flagged)))


@query("f12_profile_guard", "SELECT r.rule_id, b.bank_id FROM {a_rules} r JOIN {a_banks} b ON (r.confidence IS NULL OR (r.confidence = 'high' AND b.category < 2) OR (r.confidence = 'low' AND b.category >= 2)) AND r.rule_id % 25 = b.bank_id")
def _(t):
    banks = t.a_banks.select("bank_id", "category")
    fits = c("confidence").isNull() | ((c("confidence") == "high") & (c("category") < 2)) | ((c("confidence") == "low") & (c("category") >= 2))
    return t.a_rules.withColumn("bank_id", (c("rule_id") % 25).cast("int")).join(F.broadcast(banks), "bank_id").where(fits).select("rule_id", "bank_id")


@query("f15_row_validation", """
SELECT entity, field FROM (
  SELECT from_entity AS entity, unnest([CASE WHEN pct > 100 THEN 'pct' END, CASE WHEN from_entity = to_entity THEN 'self' END, CASE WHEN edge_type NOT IN ('OWNS', 'CONTROLS', 'COMMON_MANAGEMENT', 'ECONOMIC_DEPENDENCE') THEN 'edge_type' END, CASE WHEN to_entity NOT IN (SELECT entity_id FROM {a_entities} WHERE entity_type <> 'individual') THEN 'to_entity' END]) AS field FROM {a_edges}) x WHERE field IS NOT NULL""")
def _(t):
    known = t.a_entities.where("entity_type <> 'individual'").select(c("entity_id").alias("to_entity"), F.lit(True).alias("known"))
    bad = F.array_compact(F.array(F.when(c("pct") > 100, "pct"), F.when(c("from_entity") == c("to_entity"), "self"), F.when(~c("edge_type").isin("OWNS", "CONTROLS", "COMMON_MANAGEMENT", "ECONOMIC_DEPENDENCE"), "edge_type"), F.when(c("known").isNull(), "to_entity")))
    return t.a_edges.join(known, "to_entity", "left").select(c("from_entity").alias("entity"), F.explode(bad).alias("field"))


@query("f16_range_flags", """
SELECT rule_id, unnest(list_filter([CASE WHEN unit = '%' AND (v < 0 OR v > 100) THEN 'percent_out_of_range' END, CASE WHEN unit = 'days' AND v < 0 THEN 'negative_days' END, CASE WHEN unit = 'days' AND v > 3660 THEN 'days_over_ten_years' END, CASE WHEN unit NOT IN ('%', 'days') AND v < 0 THEN 'negative_value' END], lambda x: x IS NOT NULL)) AS flag
FROM (SELECT rule_id, unit, threshold * 100 - 700 AS v FROM {a_rules}) x""")
def _(t):
    from ..functions.numbers import range_flags

    return t.a_rules.select("rule_id", F.explode(range_flags(c("threshold") * 100 - 700, c("unit"))).alias("flag"))


@query("f17_dashboard_filter", "SELECT rule_id, bank_id FROM {a_rules} JOIN {a_submissions} USING (rule_id) WHERE fy = 1997 AND quarter = 2 AND variable_text ILIKE '%ring%'")
def _(t):
    return t.a_rules.where(c("variable_text").ilike("%ring%")).join(t.a_submissions.where("fy = 1997 AND quarter = 2"), "rule_id").select("rule_id", "bank_id")


@query("f18_filter_before_top", "SELECT chunk_id, length(text) AS n FROM {a_chunks} WHERE category = 'de' ORDER BY n DESC, chunk_id LIMIT 20")
def _(t):
    return t.a_chunks.where("category = 'de'").select("chunk_id", F.length("text").cast("long").alias("n")).orderBy(c("n").desc(), "chunk_id").limit(20)


# --- joins -----------------------------------------------------------------------------------------------------


@query("j01_rules_clauses_documents", "SELECT r.rule_id, c.clause_id, d.doc_id, d.title FROM {a_rules} r JOIN {a_clauses} c USING (clause_id) JOIN {a_documents} d USING (doc_id)")
def _(t):
    return t.a_rules.join(t.a_clauses, "clause_id").join(t.a_documents.select("doc_id", "title"), "doc_id").select("rule_id", "clause_id", "doc_id", "title")


@query("j02_rules_mappings", "SELECT r.rule_id, m.canonical_label FROM {a_rules} r LEFT JOIN (SELECT * FROM {a_mappings} WHERE status = 'approved') m USING (rule_id)")
def _(t):
    return t.a_rules.join(t.a_mappings.where("status = 'approved'"), "rule_id", "left").select("rule_id", "canonical_label")


@query("j03_on_clause_predicate", "SELECT c.clause_id, r.rule_id FROM {a_clauses} c LEFT JOIN {a_rules} r ON r.clause_id = c.clause_id AND r.atom_kind = 'requirement'")
def _(t):
    return t.a_clauses.join(t.a_rules.where("atom_kind = 'requirement'").select("clause_id", "rule_id"), "clause_id", "left").select("clause_id", "rule_id")


@query("j04_semi", "SELECT count(*) AS n FROM {a_clauses} WHERE doc_id IN (SELECT doc_id FROM {a_doc_categories} WHERE category = 1)")
def _(t):
    return t.a_clauses.join(t.a_doc_categories.where("category = 1"), "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("j05_anti", "SELECT clause_id FROM {a_clauses} WHERE clause_id NOT IN (SELECT clause_id FROM {a_rules})")
def _(t):
    return t.a_clauses.join(t.a_rules.select("clause_id"), "clause_id", "left_anti").select("clause_id")


@query("j06_submission_lookup", "SELECT r.rule_id, s.value FROM {a_rules} r LEFT JOIN (SELECT rule_id, value FROM {a_submissions} WHERE bank_id = 3 AND fy = 1998 AND quarter = 1) s USING (rule_id)")
def _(t):
    return t.a_rules.select("rule_id").join(t.a_submissions.where("bank_id = 3 AND fy = 1998 AND quarter = 1").select("rule_id", "value"), "rule_id", "left")


@query("j07_chunk_parent", "SELECT c.clause_id, p.clause_id AS parent, d.title FROM {a_clauses} c JOIN {a_clauses} p ON p.doc_id = c.doc_id AND p.seq = c.seq - c.seq % 5 + 1 JOIN {a_documents} d ON d.doc_id = p.doc_id")
def _(t):
    parent = t.a_clauses.select("doc_id", c("seq").alias("parent_seq"), c("clause_id").alias("parent"))
    child = t.a_clauses.select("doc_id", "clause_id", (c("seq") - c("seq") % 5 + 1).alias("parent_seq"))
    return child.join(parent, ["doc_id", "parent_seq"]).join(t.a_documents.select("doc_id", "title"), "doc_id").select("clause_id", "parent", "title")


@query("j08_reference_self_join", "SELECT x.ref_id, c.clause_id, c.seq, d.title FROM {a_references} x LEFT JOIN {a_clauses} c ON c.clause_id = x.to_clause LEFT JOIN {a_documents} d ON d.doc_id = c.doc_id")
def _(t):
    return t.a_references.join(t.a_clauses, t.a_references.to_clause == c("clause_id"), "left").join(t.a_documents.select("doc_id", "title"), "doc_id", "left").select("ref_id", "clause_id", "seq", "title")


@query("j09_footnotes_in_range", "SELECT c.clause_id, count(*) AS n FROM {a_clauses} c JOIN {a_footnotes} f ON f.doc_id = c.doc_id AND f.page BETWEEN c.page AND c.page_end GROUP BY c.clause_id")
def _(t):
    notes = t.a_footnotes.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("k"))
    pages = t.a_clauses.select("clause_id", "doc_id", F.explode(F.sequence("page", "page_end")).alias("page"))
    return pages.join(notes, ["doc_id", "page"]).groupBy("clause_id").agg(F.sum("k").alias("n"))


@query("j13_theta_operator", f"SELECT rule_id, bank_id, fy, quarter, value, {_CMP} AS ok FROM {{a_rules}} JOIN {{a_submissions}} USING (rule_id)")
def _(t):
    return t.a_rules.join(t.a_submissions, "rule_id").select("rule_id", "bank_id", "fy", "quarter", "value", compare(c("value"), c("operator"), c("threshold")).alias("ok"))


_CARRY = "SELECT o.rule_id AS old_id, n.rule_id AS new_id, count(*) OVER (PARTITION BY o.rule_id) AS k FROM {a_rules} o JOIN {a_rules} n ON o.operator = n.operator AND o.threshold = n.threshold AND o.unit = n.unit AND o.brand = n.brand"


@query("j14_unique_carry_over", f"SELECT old_id, new_id FROM ({_CARRY}) x WHERE k = 1")
def _(t):
    key = ["operator", "threshold", "unit", "brand"]
    new = t.a_rules.groupBy(*key).agg(F.count(F.lit(1)).alias("k"), F.min("rule_id").alias("new_id")).where("k = 1")
    return t.a_rules.join(new, key).select(c("rule_id").alias("old_id"), "new_id")


@query("j15_resolve_references", "SELECT x.ref_id, min(d.doc_id) AS target FROM {a_references} x JOIN {a_documents} d ON starts_with(d.title, concat('Supplier#00000000', CAST(x.ref_id % 10 AS STRING))) AND d.doc_id <> x.ref_id GROUP BY x.ref_id")
def _(t):
    prefix = F.concat(F.lit("Supplier#00000000"), (c("ref_id") % 10).cast("string"))
    asked = t.a_references.select("ref_id", prefix.alias("prefix"))
    named = t.a_documents.select(c("doc_id").alias("target"), F.substring("title", 1, 18).alias("prefix"))
    return asked.join(named, "prefix").where("target <> ref_id").groupBy("ref_id").agg(F.min("target").alias("target"))


@query("j16_watch_list", "SELECT w.bank_id, d.doc_id FROM (SELECT bank_id, max_by(value, submitted_at) AS v FROM {a_history} GROUP BY bank_id) w LEFT JOIN {a_documents} d ON d.doc_id = w.bank_id WHERE d.label IS DISTINCT FROM 'v1'")
def _(t):
    watch = t.a_history.select("bank_id").distinct()
    docs = t.a_documents.select(c("doc_id"), "label")
    return watch.join(docs, watch.bank_id == docs.doc_id, "left").where(~c("label").eqNullSafe("v1")).select("bank_id", "doc_id")


@query("j20_fixed_against_routed", "SELECT f.case_id, f.pred IS NOT DISTINCT FROM g.gold AS agree FROM {a_cases} f LEFT JOIN (SELECT case_id, gold FROM {a_cases} WHERE cost % 2 = 0) g USING (case_id)")
def _(t):
    return t.a_cases.select("case_id", "pred").join(t.a_cases.where("cost % 2 = 0").select("case_id", "gold"), "case_id", "left").select("case_id", c("pred").eqNullSafe(c("gold")).alias("agree"))


@query("j21_tolerance_join", "SELECT a.rule_id, b.rule_id AS other FROM {a_rules} a JOIN {a_rules} b ON a.brand = b.brand AND a.operator = b.operator AND abs(a.threshold - b.threshold) < 1e-9 AND a.rule_id < b.rule_id")
def _(t):
    # Thresholds meet in buckets wider than the tolerance, or in the next one.
    at = F.floor(c("threshold") * 1e6)
    a = t.a_rules.select("rule_id", "brand", "operator", "threshold", at.alias("at"))
    b = t.a_rules.select(c("rule_id").alias("other"), "brand", "operator", c("threshold").alias("near"), F.explode(F.array(at - 1, at, at + 1)).alias("at"))
    return a.join(b, ["brand", "operator", "at"]).where((F.abs(c("threshold") - c("near")) < 1e-9) & (c("rule_id") < c("other"))).select("rule_id", "other")


@query("j22_relaxed_operator", "SELECT a.rule_id, count(*) AS n FROM {a_rules} a JOIN {a_rules} b ON a.brand = b.brand AND replace(a.operator, '=', '') = replace(b.operator, '=', '') AND abs(a.threshold - b.threshold) <= 1e-6 GROUP BY a.rule_id")
def _(t):
    loose = t.a_rules.select("rule_id", "brand", F.replace("operator", F.lit("="), F.lit("")).alias("op"), F.round(c("threshold") * 1e6).alias("at"))
    return loose.join(loose.groupBy("brand", "op", "at").agg(F.count(F.lit(1)).alias("n")), ["brand", "op", "at"]).select("rule_id", "n")


@query("j23_already_submitted", "SELECT r.rule_id, s.rule_id IS NOT NULL AS submitted FROM {a_rules} r LEFT JOIN (SELECT DISTINCT rule_id FROM {a_submissions} WHERE bank_id = 2 AND fy = 1999) s USING (rule_id)")
def _(t):
    done = t.a_submissions.where("bank_id = 2 AND fy = 1999").select("rule_id", F.lit(True).alias("submitted")).distinct()
    return t.a_rules.select("rule_id").join(done, "rule_id", "left").select("rule_id", c("submitted").isNotNull().alias("submitted"))


@query("j25_class_fallback", """
SELECT entity_id, limit_pct FROM (SELECT e.entity_id, r.limit_pct, row_number() OVER (PARTITION BY e.entity_id ORDER BY e.rank) AS rn
  FROM (SELECT entity_id, unnest(k) AS cls, unnest(range(1, len(k) + 1)) AS rank FROM (SELECT entity_id, CASE WHEN entity_type = 'nbfc' AND gold_loan THEN ['gold_nbfc', 'nbfc', 'default'] WHEN entity_type = 'nbfc' THEN ['nbfc', 'default'] WHEN entity_type = 'bank' THEN ['bank', 'default'] ELSE ['default'] END AS k FROM {a_entities}) z) e
  JOIN (VALUES ('default', 20.0), ('bank', 25.0), ('gold_nbfc', 7.5)) r(cls, limit_pct) ON r.cls = e.cls) x WHERE rn = 1""")
def _(t):
    from ..operators.graph import counterparty_classes, pick_limit

    return pick_limit(counterparty_classes(t.a_entities), {"default": 20.0, "bank": 25.0, "gold_nbfc": 7.5}).select("entity_id", "limit_pct")


@query("j27_definition_lookup", "SELECT rule_id FROM {a_rules} WHERE lower(variable_text) = 'red ring' OR lower(variable_text) LIKE '%red ring%'")
def _(t):
    return t.a_rules.where((F.lower("variable_text") == "red ring") | F.lower("variable_text").contains("red ring")).select("rule_id")


# --- aggregations ----------------------------------------------------------------------------------------------


@query("a01_documents_per_category", "SELECT category, count(*) AS n FROM {a_doc_categories} GROUP BY category")
def _(t):
    return t.a_doc_categories.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("a02_corpus_statistics", "SELECT ctype, role, count(*) AS n, sum(text_length) AS chars, count(DISTINCT doc_id) AS docs FROM {a_clauses} GROUP BY ctype, role")
def _(t):
    return t.a_clauses.groupBy("ctype", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("text_length").alias("chars"), F.countDistinct("doc_id").alias("docs"))


@query("a02_six_counts", "SELECT 'documents' AS what, count(*) AS n FROM {a_documents} UNION ALL SELECT 'clauses', count(*) FILTER (NOT deleted) FROM {a_clauses} UNION ALL SELECT 'rules', count(*) FILTER (atom_kind = 'requirement') FROM {a_rules} UNION ALL SELECT 'definitions', count(*) FILTER (role = 'definition') FROM {a_clauses} UNION ALL SELECT 'references', count(*) FROM {a_references} UNION ALL SELECT 'footnotes', count(*) FROM {a_footnotes}")
def _(t):
    of = lambda what, rows: rows.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"))
    parts = [of("documents", t.a_documents), of("clauses", t.a_clauses.where("NOT deleted")), of("rules", t.a_rules.where("atom_kind = 'requirement'")), of("definitions", t.a_clauses.where("role = 'definition'")), of("references", t.a_references), of("footnotes", t.a_footnotes)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4]).union(parts[5])


@query("a12_overall_verdict", f"SELECT bank_id, CASE WHEN bool_or(status = 'BREACH') THEN 'BREACH' WHEN bool_or(flag <> 'none') THEN 'ATTENTION' WHEN bool_or(status = 'PASS') THEN 'PASS' ELSE 'INSUFFICIENT_DATA' END AS overall FROM (SELECT bank_id, status, CASE WHEN rule_id % 50 = 7 THEN 'unusual' ELSE 'none' END AS flag FROM ({_CHECK}) x WHERE bank_id IS NOT NULL AND NOT (bank_id % 2 = 0 AND status = 'BREACH') AND NOT (bank_id % 4 = 0 AND rule_id % 50 = 7)) y GROUP BY bank_id")
def _(t):
    checked = R.check_rules(t.a_rules, t.a_submissions, ["bank_id"]).where("bank_id IS NOT NULL AND NOT (bank_id % 2 = 0 AND status = 'BREACH') AND NOT (bank_id % 4 = 0 AND rule_id % 50 = 7)")
    return R.overall_verdict(checked, "bank_id", c("rule_id") % 50 == 7)


@query("a03_conditional_sums", "SELECT doc_id, count(*) FILTER (role = 'obligation') AS obligations, count(*) FILTER (ctype = 'quantitative') AS quantitative FROM {a_clauses} GROUP BY doc_id")
def _(t):
    return t.a_clauses.groupBy("doc_id").agg(F.count_if(c("role") == "obligation").alias("obligations"), F.count_if(c("ctype") == "quantitative").alias("quantitative"))


@query("a04_counts_per_document", "SELECT d.doc_id, (SELECT count(*) FROM {a_clauses} c WHERE c.doc_id = d.doc_id AND c.deleted) AS n_deleted FROM {a_documents} d")
def _(t):
    counts = t.a_clauses.where("deleted").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
    return t.a_documents.join(counts, "doc_id", "left").select("doc_id", F.coalesce("k", F.lit(0)).alias("n_deleted"))


@query("a05_topic_roll_up", "SELECT topic, count(*) AS docs, count(DISTINCT category) AS categories, max(label) AS last_label FROM {a_documents} GROUP BY topic")
def _(t):
    return t.a_documents.groupBy("topic").agg(F.count(F.lit(1)).alias("docs"), F.countDistinct("category").alias("categories"), F.max("label").alias("last_label"))


@query("a09_decision_counts", "SELECT l.label, count(x.pred) AS n FROM (VALUES ('COMPLIANT'), ('NON_COMPLIANT'), ('INSUFFICIENT_DATA'), ('AMBIGUOUS'), ('REQUIRES_HUMAN_REVIEW')) l(label) LEFT JOIN {a_cases} x ON x.pred = l.label GROUP BY l.label")
def _(t):
    labels = t.spark.createDataFrame([(x,) for x in ("COMPLIANT", "NON_COMPLIANT", "INSUFFICIENT_DATA", "AMBIGUOUS", "REQUIRES_HUMAN_REVIEW")], "label string")
    counts = t.a_cases.groupBy(c("pred").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return labels.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


_SEVERITY_SQL = "CASE status " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEVERITY)) + " END"


@query("a10_worst_status", f"SELECT rule_id, arg_min(status, {_SEVERITY_SQL}) AS worst FROM ({_CHECK}) x WHERE status <> 'NOT_REPORTED' GROUP BY rule_id")
def _(t):
    checked = R.check_rules(t.a_rules, t.a_submissions).where("status <> 'NOT_REPORTED'")
    return checked.groupBy("rule_id").agg(F.min_by("status", severity(c("status"))).alias("worst"))


@query("a11_report_summary", f"SELECT bank_id, count(*) AS total, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'BREACH') AS breached, count(DISTINCT rule_id) AS rules, CASE WHEN count(*) FILTER (status = 'BREACH') > 0 THEN 'BREACH' WHEN count(*) FILTER (status = 'PASS') > 0 THEN 'PASS' ELSE 'INSUFFICIENT_DATA' END AS overall FROM ({_CHECK}) x WHERE bank_id IS NOT NULL GROUP BY bank_id")
def _(t):
    checked = R.check_rules(t.a_rules, t.a_submissions, ["bank_id"]).where("bank_id IS NOT NULL")
    sums = checked.groupBy("bank_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(c("status") == "PASS").alias("passed"), F.count_if(c("status") == "BREACH").alias("breached"), F.countDistinct("rule_id").alias("rules"))
    return sums.withColumn("overall", F.when(c("breached") > 0, "BREACH").when(c("passed") > 0, "PASS").otherwise("INSUFFICIENT_DATA"))


@query("a13_agreement_rate", "SELECT round(avg(CASE WHEN pred = gold THEN 1.0 ELSE 0.0 END), 9) AS rate FROM {a_cases}")
def _(t):
    return t.a_cases.agg(F.round(F.avg((c("pred") == c("gold")).cast("double")), 9).alias("rate"))


@query("a25_numbering_gaps", "SELECT doc_id, n FROM (SELECT doc_id, unnest(range(1, max(page) + 1)) AS n FROM {a_clauses} GROUP BY doc_id) x WHERE (doc_id, n) NOT IN (SELECT doc_id, page FROM {a_clauses})")
def _(t):
    full = t.a_clauses.groupBy("doc_id").agg(F.max("page").alias("top")).where("top >= 1").select("doc_id", F.explode(F.sequence(F.lit(1), "top")).alias("page"))
    return full.join(t.a_clauses.select("doc_id", "page"), ["doc_id", "page"], "left_anti").select("doc_id", c("page").cast("long").alias("n"))


@query("a26_distribution", "SELECT role, count(*) FILTER (ctype = 'quantitative') AS quantitative, count(*) FILTER (ctype = 'qualitative') AS qualitative, count(*) FILTER (ctype = 'relational') AS relational FROM {a_clauses} GROUP BY role")
def _(t):
    kinds = ["quantitative", "qualitative", "relational"]
    return t.a_clauses.groupBy("role").pivot("ctype", kinds).agg(F.count(F.lit(1))).fillna(0, kinds)


@query("a29_stage_counters", "SELECT 'clauses' AS stage, count(*) AS n FROM {a_clauses} UNION ALL SELECT 'rules', count(*) FROM {a_rules} UNION ALL SELECT 'references', count(*) FROM {a_references} UNION ALL SELECT 'documents', count(*) FROM {a_documents}")
def _(t):
    counts = [df.agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n")) for name, df in (("clauses", t.a_clauses), ("rules", t.a_rules), ("references", t.a_references), ("documents", t.a_documents))]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query("a31_distinct_facts", "SELECT (SELECT count(DISTINCT clause_id) FROM {a_rules}) AS clauses, (SELECT count(DISTINCT doc_id) FROM {a_clauses}) AS docs, (SELECT count(DISTINCT rule_id) FROM {a_submissions}) AS reported")
def _(t):
    one = t.a_rules.agg(F.countDistinct("clause_id").alias("clauses"))
    return one.join(t.a_clauses.agg(F.countDistinct("doc_id").alias("docs"))).join(t.a_submissions.agg(F.countDistinct("rule_id").alias("reported")))


@query("a32_extraction_audit", r"SELECT source, count(*) AS docs, count(*) FILTER (NOT regexp_matches(text, '[.!?:;]\s*$')) AS cut_off, count(*) FILTER (regexp_matches(text, '(?m)^\s*[0-9]+\s*$')) AS page_leaks FROM {documents} GROUP BY source")
def _(t):
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if(~c("text").rlike(r"[.!?:;]\s*\z")).alias("cut_off"), F.count_if(c("text").rlike(r"(?m)^\s*[0-9]+\s*$")).alias("page_leaks"))


@query("a32_duplicate_groups", "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM {documents} GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return t.documents.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


# --- windows ---------------------------------------------------------------------------------------------------


@query("w01_round_robin_sample", "SELECT clause_id, turn FROM (SELECT clause_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS turn FROM {a_clauses} WHERE role = 'obligation') x ORDER BY turn, doc_id LIMIT 100")
def _(t):
    return R.round_robin(t.a_clauses.where("role = 'obligation'"), "doc_id", [c("seq")], 100).select("clause_id", "turn")


@query("w02_best_per_clause_capped", "SELECT clause_id, doc_id, text_length FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY text_length DESC, clause_id) AS rn FROM {a_clauses}) x WHERE rn <= 3 ORDER BY text_length DESC, clause_id LIMIT 50")
def _(t):
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(c("text_length").desc(), "clause_id"))
    return t.a_clauses.withColumn("rn", rank).where("rn <= 3").orderBy(c("text_length").desc(), "clause_id").limit(50).select("clause_id", "doc_id", "text_length")


@query("w03_neighbours", "SELECT clause_id, lag(clause_id) OVER w AS before, lead(clause_id) OVER w AS after FROM {a_clauses} WHERE NOT deleted WINDOW w AS (PARTITION BY doc_id ORDER BY seq)")
def _(t):
    w = Window.partitionBy("doc_id").orderBy("seq")
    return t.a_clauses.where("NOT deleted").select("clause_id", F.lag("clause_id").over(w).alias("before"), F.lead("clause_id").over(w).alias("after"))


@query("w04_last_eight", "SELECT bank_id, rule, count(*) AS n, max(value) AS top FROM (SELECT *, row_number() OVER (PARTITION BY bank_id, rule ORDER BY submitted_at DESC, event_id DESC) AS rn FROM {a_history}) x WHERE rn <= 8 GROUP BY bank_id, rule")
def _(t):
    rank = F.row_number().over(Window.partitionBy("bank_id", "rule").orderBy(c("submitted_at").desc(), c("event_id").desc()))
    return t.a_history.withColumn("rn", rank).where("rn <= 8").groupBy("bank_id", "rule").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


@query("w05_latest_row", "SELECT bank_id, rule, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY bank_id, rule ORDER BY submitted_at DESC, event_id DESC) AS rn FROM {a_history}) x WHERE rn = 1")
def _(t):
    last = F.max_by(F.struct("event_id", "value"), F.struct("submitted_at", "event_id")).alias("last")
    return t.a_history.groupBy("bank_id", "rule").agg(last).select("bank_id", "rule", "last.event_id", "last.value")


@query("w06_first_atom", "SELECT brand, arg_min(operator, rule_id) AS operator, min(rule_id) AS rule_id FROM {a_rules} WHERE atom_kind = 'requirement' GROUP BY brand")
def _(t):
    return t.a_rules.where("atom_kind = 'requirement'").groupBy("brand").agg(F.min_by("operator", "rule_id").alias("operator"), F.min("rule_id").alias("rule_id"))


@query("w09_top_three_deduped", "SELECT variable_text, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY variable_text ORDER BY threshold DESC, rule_id) AS rn FROM (SELECT variable_text, operator, threshold, min(rule_id) AS rule_id FROM {a_rules} GROUP BY ALL) y) x WHERE rn <= 3")
def _(t):
    unique = t.a_rules.groupBy("variable_text", "operator", "threshold").agg(F.min("rule_id").alias("rule_id"))
    rank = F.row_number().over(Window.partitionBy("variable_text").orderBy(c("threshold").desc(), "rule_id"))
    return unique.withColumn("rn", rank).where("rn <= 3").select("variable_text", "rule_id")


@query("w12_numbering", "SELECT clause_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS chunk_index FROM {a_clauses}")
def _(t):
    return t.a_clauses.select("clause_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1).alias("chunk_index"))


@query("w13_sliding_windows", "SELECT chunk_id, i, substr(text, i * 600 + 1, 800) AS piece FROM (SELECT chunk_id, text, unnest(range(0, CAST(ceil(greatest(length(text) - 800, 0) / 600.0) AS BIGINT) + 1)) AS i FROM {a_chunks}) x")
def _(t):
    from ..operators.retrieval import sliding_windows

    return sliding_windows(t.a_chunks, "chunk_id", "text", 800, 200)


@query("w15_per_document_cap", "SELECT clause_id FROM (SELECT clause_id, row_number() OVER (PARTITION BY doc_id ORDER BY md5(CAST(clause_id AS STRING))) AS rn FROM {a_clauses}) x WHERE rn <= 3")
def _(t):
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.md5(c("clause_id").cast("string"))))
    return t.a_clauses.withColumn("rn", rank).where("rn <= 3").select("clause_id")


@query("w16_repeated_lines", r"SELECT source, line, count(DISTINCT doc_id) AS docs FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM {documents}) x WHERE line <> '' GROUP BY source, line HAVING count(DISTINCT doc_id) >= 2")
def _(t):
    lines = t.documents.select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''").distinct()
    return lines.groupBy("source", "line").agg(F.count(F.lit(1)).alias("docs")).where("docs >= 2")


@query("w18_stratified_sample", "SELECT rule_id FROM (SELECT rule_id, row_number() OVER (PARTITION BY brand ORDER BY sha1(concat('7:', CAST(rule_id AS STRING)))) AS rn FROM {a_rules}) x WHERE rn <= 40")
def _(t):
    rank = F.row_number().over(Window.partitionBy("brand").orderBy(F.sha1(F.concat(F.lit("7:"), c("rule_id").cast("string")))))
    return t.a_rules.withColumn("rn", rank).where("rn <= 40").select("rule_id")


@query("w19_last_turns", "SELECT conv_id, count(*) FILTER (rn <= 6) AS recent, arg_max(text, turn) FILTER (role = 'user') AS question FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM {conversations}) x GROUP BY conv_id")
def _(t):
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(c("turn").desc()))
    asked = F.max_by(F.when(c("role") == "user", c("text")), F.when(c("role") == "user", c("turn")))
    return t.conversations.withColumn("rn", rank).groupBy("conv_id").agg(F.count_if(c("rn") <= 6).alias("recent"), asked.alias("question"))


# --- sorts and limits ------------------------------------------------------------------------------------------


@query("o01_vector_top_k", "SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS score FROM {embeddings} q JOIN {embeddings} e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) DESC, e.vec_id) <= 5")
def _(t):
    from ..operators.retrieval import vector_top_k

    return vector_top_k(t.embeddings.where("vec_id % 100 = 0"), t.embeddings, 5)


@query("o04_page", "SELECT rule_id, count(*) OVER () AS total FROM {a_rules} ORDER BY rule_id LIMIT 25 OFFSET 50")
def _(t):
    total = t.a_rules.agg(F.count(F.lit(1)).alias("total"))
    return t.a_rules.select("rule_id").orderBy("rule_id").offset(50).limit(25).join(F.broadcast(total))


@query("o05_severity_order", f"SELECT rule_id, bank_id, fy, quarter, status FROM ({_CHECK}) x ORDER BY {_SEVERITY_SQL} NULLS FIRST, rule_id, bank_id, fy, quarter")
def _(t):
    checked = R.check_rules(t.a_rules, t.a_submissions, ["bank_id", "fy", "quarter"])
    return checked.orderBy(severity(c("status")).asc_nulls_first(), "rule_id", "bank_id", "fy", "quarter").select("rule_id", "bank_id", "fy", "quarter", "status")


@query("o06_display_trim", "SELECT entity_id FROM {a_entities} ORDER BY CASE WHEN entity_type = 'bank' THEN 0 WHEN gold_loan THEN 1 ELSE 2 END, balance DESC, entity_id LIMIT 300")
def _(t):
    priority = F.when(c("entity_type") == "bank", 0).when(c("gold_loan"), 1).otherwise(2)
    return t.a_entities.orderBy(priority, c("balance").desc(), "entity_id").limit(300).select("entity_id")


@query("o08_report_sort", "SELECT case_id, pred FROM {a_cases} ORDER BY CASE pred WHEN 'NON_COMPLIANT' THEN 0 WHEN 'REQUIRES_HUMAN_REVIEW' THEN 1 ELSE 2 END, case_id")
def _(t):
    rank = F.when(c("pred") == "NON_COMPLIANT", 0).when(c("pred") == "REQUIRES_HUMAN_REVIEW", 1).otherwise(2)
    return t.a_cases.orderBy(rank, "case_id").select("case_id", "pred")


# --- set operations --------------------------------------------------------------------------------------------


@query("u02_ordered_union", "SELECT clause_id, min(src) AS src FROM (SELECT clause_id, 0 AS src FROM {a_rules} UNION ALL SELECT clause_id, 1 FROM {a_clauses} WHERE ctype = 'relational') x GROUP BY clause_id")
def _(t):
    both = t.a_rules.select("clause_id", F.lit(0).alias("src")).unionByName(t.a_clauses.where("ctype = 'relational'").select("clause_id", F.lit(1).alias("src")))
    return both.groupBy("clause_id").agg(F.min("src").alias("src"))


@query("u05_append_missing", "SELECT clause_id FROM (SELECT clause_id, 0 AS k FROM {a_clauses} WHERE role = 'definition' AND doc_id = 3 UNION SELECT clause_id, 1 FROM {a_clauses} WHERE doc_id = 3 AND role <> 'definition') x ORDER BY k, clause_id LIMIT 40")
def _(t):
    first = t.a_clauses.where("role = 'definition' AND doc_id = 3").select("clause_id", F.lit(0).alias("k"))
    more = t.a_clauses.where("doc_id = 3").select("clause_id", F.lit(1).alias("k")).join(first, "clause_id", "left_anti")
    return first.unionByName(more).orderBy("k", "clause_id").limit(40).select("clause_id")


@query("u06_result_families", f"SELECT kind, decision, count(*) AS n FROM (SELECT 'rule' AS kind, {_DECIDE} AS decision FROM ({_CHECK}) y UNION ALL SELECT 'case', pred FROM {{a_cases}}) x GROUP BY ALL")
def _(t):
    checked = R.check_rules(t.a_rules, t.a_submissions).select(F.lit("rule").alias("kind"), decision(c("status")).alias("decision"))
    return checked.unionByName(t.a_cases.select(F.lit("case").alias("kind"), c("pred").alias("decision"))).groupBy("kind", "decision").agg(F.count(F.lit(1)).alias("n"))


@query("u07_duplicate_ids", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM {lineitem} GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("u08_topic_overlap", "SELECT a.doc_id, b.doc_id AS other FROM {a_documents} a JOIN {a_documents} b ON a.doc_id < b.doc_id AND a.topic = b.topic AND list_has_any([a.category, (a.category + 1) % 5], [b.category, (b.category + 2) % 5])")
def _(t):
    a = t.a_documents.select("doc_id", "topic", F.array("category", (c("category") + 1) % 5).alias("x"))
    b = t.a_documents.select(c("doc_id").alias("other"), "topic", F.array("category", (c("category") + 2) % 5).alias("y"))
    return a.join(b, "topic").where((c("doc_id") < c("other")) & F.arrays_overlap("x", "y")).select("doc_id", "other")


@query("u09_missing", "SELECT rule_id FROM {a_rules} EXCEPT SELECT rule_id FROM {a_submissions} WHERE fy = 2000")
def _(t):
    return t.a_rules.select("rule_id").join(t.a_submissions.where("fy = 2000").select("rule_id"), "rule_id", "left_anti").distinct()


@query("u11_distinct_pairs", "SELECT DISTINCT bank_id, rule_id FROM {a_submissions}")
def _(t):
    return t.a_submissions.select("bank_id", "rule_id").distinct()


@query("u12_found_and_checked", "SELECT coalesce(a.rule_id, b.rule_id) AS rule_id, a.rule_id IS NOT NULL AS found, b.rule_id IS NOT NULL AS checked FROM (SELECT DISTINCT rule_id FROM {a_submissions} WHERE fy = 1996) a FULL JOIN (SELECT rule_id FROM {a_rules} WHERE atom_kind = 'requirement') b ON a.rule_id = b.rule_id")
def _(t):
    a = t.a_submissions.where("fy = 1996").select("rule_id", F.lit(True).alias("a")).distinct()
    b = t.a_rules.where("atom_kind = 'requirement'").select("rule_id", F.lit(True).alias("b"))
    return a.join(b, "rule_id", "full_outer").select("rule_id", c("a").isNotNull().alias("found"), c("b").isNotNull().alias("checked"))


# --- upserts and their kin -------------------------------------------------------------------------------------


@query("s20_upsert", "SELECT bank_id, rule_id, fy, quarter, value FROM {a_submissions}")
def _(t):
    order = [c(x).desc() for x in ("submitted_at", "l_orderkey", "l_linenumber", "l_suppkey", "value")]
    return R.latest(t.a_reports, ["bank_id", "rule_id", "fy", "quarter"], order).select("bank_id", "rule_id", "fy", "quarter", "value")


@query("s21_insert_or_ignore", "SELECT DISTINCT text AS evidence FROM {documents} WHERE doc_id % 3 <> 0 AND text NOT IN (SELECT text FROM {documents} WHERE doc_id % 3 = 0 AND text IS NOT NULL)")
def _(t):
    from ..sources.sinks import insert_or_ignore

    rows = t.documents.select("doc_id", c("text").alias("evidence")).where("evidence IS NOT NULL")
    return insert_or_ignore(rows.where("doc_id % 3 = 0"), rows.where("doc_id % 3 <> 0"), ["evidence"]).select("evidence")


@query("s23_cascading_delete", "SELECT from_entity, to_entity, CASE WHEN to_entity % 50 = 0 THEN NULL ELSE to_entity END AS provider FROM {a_edges} WHERE from_entity % 50 <> 0")
def _(t):
    gone = t.a_entities.where("entity_id % 50 = 0").select("entity_id")
    kept = t.a_edges.join(gone, c("from_entity") == c("entity_id"), "left_anti")
    return kept.join(gone, c("to_entity") == c("entity_id"), "left").select("from_entity", "to_entity", F.when(c("entity_id").isNull(), c("to_entity")).alias("provider"))


@query("s24_content_dedupe", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY source = 'src0', length(source), doc_id) AS rn FROM {documents}) x WHERE rn = 1")
def _(t):
    rank = F.row_number().over(Window.partitionBy(F.sha2("text", 256)).orderBy(c("source") == "src0", F.length("source"), "doc_id"))
    return t.documents.withColumn("rn", rank).where("rn = 1").select("doc_id")
