"""Text, dates, hashes, sources and chunking as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers as N
from ..functions import text as X
from ..functions import wording as W
from ..operators import retrieval as T
from .registry import query

c = F.col


@query("c01_normal_key", "SELECT rule_id, trim(regexp_replace(lower(concat(variable_text, ' / ', brand)), '[^a-z0-9]+', ' ', 'g')) AS k FROM {a_rules}")
def _(t):
    return t.a_rules.select("rule_id", X.normal_key(F.concat("variable_text", F.lit(" / "), "brand")).alias("k"))


@query("c02_sentences")
def _(t):
    return t.fx_clauses.select("clause_id", F.posexplode(X.sentences(c("text"))).alias("i", "sentence"))


@query("c03_numbers", r"SELECT id, CASE WHEN regexp_matches(x, '^\s*\(.*\)\s*%?\s*$') THEN -v ELSE v END AS value FROM (SELECT id, x, TRY_CAST(regexp_replace(regexp_replace(x, '(?i)\s*(?:%|per cent|percent)\s*', '', 'g'), '[,()\s]', '', 'g') AS DOUBLE) AS v FROM {fx_values}) y")
def _(t):
    return t.fx_values.select("id", X.number(c("x")).alias("value"))


@query("c05_crore_factor", "SELECT unit, factor FROM (VALUES ('₹ crore', 1.0::DOUBLE), ('Rs. lakh', 0.01), ('USD million', 0.1), ('billion', 100.0), ('thousand', 0.0001), ('%', 1.0)) v(unit, factor)")
def _(t):
    return t.spark.createDataFrame([(u,) for u in ("₹ crore", "Rs. lakh", "USD million", "billion", "thousand", "%")], "unit string").select("unit", X.crore_factor(c("unit")).alias("factor"))


_ATOM_OP = r"CASE WHEN regexp_matches(text, '(?i)\b(?:shall|should|must|may|does|do) not exceed\b|\bnot more than\b|\bmaximum of\b|\bup to\b|\bceiling of\b') THEN '<=' WHEN regexp_matches(text, '(?i)\bnot less than\b|\bminimum of\b|\bat least\b|\bnot be less than\b') THEN '>=' WHEN regexp_matches(text, '(?i)\bwithin\b.*\b(?:days?|months?|years?)\b') THEN 'within_days' WHEN regexp_matches(text, '(?i)\bless than\b|\bbelow\b') THEN '<' WHEN regexp_matches(text, '(?i)\bmore than\b|\bexceed(?:s|ing)?\b|\babove\b') THEN '>' END"


@query("c06_c08_rule_atoms", rf"""
SELECT clause_id, op AS operator, CASE WHEN p <> '' THEN CAST(p AS DOUBLE) WHEN m <> '' THEN CAST(m AS DOUBLE) WHEN d <> '' THEN CAST(d AS DOUBLE) WHEN k <> '' THEN CAST(k AS DOUBLE) END AS value,
       CASE WHEN p <> '' THEN '%' WHEN m <> '' THEN '₹ lakh' WHEN d <> '' THEN 'days' WHEN k <> '' THEN 'times' END AS unit FROM (
  SELECT clause_id, {_ATOM_OP} AS op, regexp_extract(t2, '(?i)([0-9]+(?:\.[0-9]+)?)\s*(?:%|per cent)', 1) AS p, regexp_extract(t2, '(?i)(?:Rs\.?|₹)\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(crore|lakh)?', 1) AS m,
         regexp_extract(t2, '(?i)([0-9]+)\s*(?:working )?(days?|months?|years?)', 1) AS d, regexp_extract(t2, '(?i)([0-9]+(?:\.[0-9]+)?)\s*times', 1) AS k
  FROM (SELECT *, replace(text, 'fifty per cent', '50 per cent') AS t2 FROM {{fx_clauses}}) y) x WHERE op IS NOT NULL AND (p <> '' OR m <> '' OR d <> '' OR k <> '')""")
def _(t):
    value, unit = X.value_and_unit(c("text"))
    return t.fx_clauses.select("clause_id", X.limit_operator(c("text")).alias("operator"), value.alias("value"), unit.alias("unit")).where("operator IS NOT NULL AND value IS NOT NULL")


@query("c11_clause_role", """SELECT clause_id, role, kind FROM (VALUES (1, 'obligation', 'quantitative'), (2, 'obligation', 'quantitative'), (3, 'obligation', 'quantitative'), (4, 'information', 'quantitative'), (5, 'obligation', 'quantitative'),
(6, 'information', 'qualitative'), (7, 'obligation', 'qualitative'), (8, 'applicability', 'qualitative'), (9, 'information', 'quantitative'), (10, 'information', 'qualitative'), (11, 'obligation', 'qualitative'), (12, 'information', 'qualitative'),
(13, 'information', 'qualitative'), (14, 'information', 'quantitative'), (15, 'information', 'qualitative')) v(clause_id, role, kind)""")
def _(t):
    return t.fx_clauses.withColumn("role", X.clause_role(c("text"))).select("clause_id", "role", X.clause_type(c("text"), c("role")).alias("kind"))


@query("c13_cross_references", "SELECT clause_id, kind, target FROM (VALUES (6, 'paragraph', '4(2)'), (6, 'annex', 'II'), (11, 'paragraph', '12'), (11, 'paragraph', '13(a)'), (14, 'annex', '3')) v(clause_id, kind, target)")
def _(t):
    return t.fx_clauses.select("clause_id", F.explode(X.cross_references(c("text"))).alias("r")).select("clause_id", "r.kind", "r.target")


@query("c12_definitions", r"""SELECT clause_id, regexp_extract(text, '"([^"]+)"\s+means\s+(.*)', 1) AS term, regexp_extract(text, '"([^"]+)"\s+means\s+(.*)', 2) AS meaning FROM {fx_clauses} WHERE regexp_matches(text, '"[^"]+"\s+means\b')""")
def _(t):
    p = r'"([^"]+)"\s+means\s+(.*)'
    return t.fx_clauses.where(c("text").rlike(r'"[^"]+"\s+means\b')).select("clause_id", F.regexp_extract("text", p, 1).alias("term"), F.regexp_extract("text", p, 2).alias("meaning"))


@query("c19_content_terms", r"SELECT question_id, list_filter(list_transform(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9.\-]*'), lambda w: regexp_replace(w, '[.\-]+$', '')), lambda w: length(w) > 1 AND w NOT IN ('a','an','and','are','as','at','be','by','for','from','in','is','it','of','on','or','that','the','to','was','with')) AS terms FROM {a_questions}")
def _(t):
    return t.a_questions.select("question_id", X.content_terms(c("text")).alias("terms"))


@query("c23_term_query", r"""SELECT question_id, array_to_string(list_transform(w[1:24], lambda x: concat('"', x, '"')), ' OR ') AS q FROM (SELECT question_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM {a_questions}) y""")
def _(t):
    return t.a_questions.select("question_id", X.any_of_terms(T.terms(c("text"))).alias("q"))


@query("c22_follow_up", "SELECT conv_id, turn, length(text) < 60 AND turn > 0 AND lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant' AS follow_up FROM {conversations} WHERE role IS NOT NULL QUALIFY role = 'user'")
def _(t):
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    flagged = t.conversations.withColumn("follow_up", (F.length("text") < 60) & (c("turn") > 0) & (before == "assistant"))
    return flagged.where("role = 'user'").select("conv_id", "turn", "follow_up")


@query("c25_iso_dates", "SELECT id, coalesce(TRY_CAST(try_strptime(x, '%Y-%m-%d') AS DATE), CAST(try_strptime(x, '%d-%m-%Y') AS DATE), CAST(try_strptime(x, '%d %B %Y') AS DATE), CAST(try_strptime(x, '%B %d, %Y') AS DATE)) AS day FROM {fx_dates}")
def _(t):
    return t.fx_dates.select("id", X.iso_date(c("x")).alias("day"))


@query("c26_fiscal_period", "SELECT o_orderkey, concat('Q', CASE WHEN m < 4 THEN 4 WHEN m < 7 THEN 1 WHEN m < 10 THEN 2 ELSE 3 END, '-FY', fy, '-', lpad(CAST((fy + 1) % 100 AS VARCHAR), 2, '0')) AS label FROM (SELECT o_orderkey, month(o_orderdate) AS m, year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END AS fy FROM {orders}) x")
def _(t):
    day = c("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", N.fiscal_label(N.fiscal_year(day), N.fiscal_quarter(day)).alias("label"))


@query("c27_tier_bands", "SELECT c_custkey, CASE WHEN c_acctbal <= 100 THEN 1 WHEN c_acctbal <= 1000 THEN 2 WHEN c_acctbal <= 10000 THEN 3 ELSE 4 END AS tier FROM {customer}")
def _(t):
    b = c("c_acctbal")
    return t.customer.select("c_custkey", N.chain([(b <= 100, F.lit(1)), (b <= 1000, F.lit(2)), (b <= 10000, F.lit(3))], F.lit(4)).alias("tier"))


@query("c29_decisions", "SELECT status, CASE WHEN status IN ('PASS', 'COVERED', 'INFO') THEN 'COMPLIANT' WHEN status IN ('BREACH', 'PROHIBITED') THEN 'NON_COMPLIANT' WHEN status = 'PARTIAL' THEN 'AMBIGUOUS' WHEN status = 'NOT_DISCLOSED' THEN 'INSUFFICIENT_DATA' ELSE 'REQUIRES_HUMAN_REVIEW' END AS decision FROM (VALUES ('PASS'), ('COVERED'), ('INFO'), ('BREACH'), ('PROHIBITED'), ('PARTIAL'), ('NOT_DISCLOSED'), ('NEEDS_REVIEW'), ('nonsense')) v(status)")
def _(t):
    rows = t.spark.createDataFrame([(s,) for s in ("PASS", "COVERED", "INFO", "BREACH", "PROHIBITED", "PARTIAL", "NOT_DISCLOSED", "NEEDS_REVIEW", "nonsense")], "status string")
    return rows.select("status", N.decision(c("status")).alias("decision"))


@query("c33_meaning_guard")
def _(t):
    simpler = F.regexp_replace("text", r"(?i)\bshall not exceed\b", "must not be more than")
    return t.fx_clauses.select("clause_id", X.meaning_kept(c("text"), simpler).alias("kept"))


_SYLLABLE = "CASE WHEN length(w) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(regexp_replace(regexp_replace(w, '([^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', ''), '[aeiouy][aeiouy]?'))) END"


@query("c34_reading_grade", rf"""
SELECT doc_id, round(CASE WHEN n > 0 AND s > 0 THEN 0.39 * n / s + 11.8 * total / n - 15.59 END, 9) AS grade FROM (
  SELECT doc_id, CAST(len(ws) AS DOUBLE) AS n, CAST(len(list_filter(regexp_split_to_array(text, '[.!?;:]+(\s|$)'), lambda x: regexp_matches(x, '[A-Za-z]'))) AS DOUBLE) AS s,
         CAST(list_sum(list_transform(list_transform(ws, lambda w: regexp_replace(lower(w), '[^a-z]', '', 'g')), lambda w: {_SYLLABLE})) AS DOUBLE) AS total
  FROM (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z][A-Za-z''\-]*') AS ws FROM {{documents}}) x) y""")
def _(t):
    return t.documents.select("doc_id", F.round(W.reading_grade(c("text")), 9).alias("grade"))


@query("c35_hash_split", "SELECT rule_id, CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'dev' ELSE 'test' END AS split FROM (SELECT rule_id, CAST(concat('0x', substr(sha1(concat('7:', CAST(rule_id AS STRING))), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u FROM {a_rules}) x")
def _(t):
    u = N.hash_share(F.concat(F.lit("7:"), c("rule_id").cast("string")))
    return t.a_rules.select("rule_id", F.when(u < 0.6, "train").when(u < 0.8, "dev").otherwise("test").alias("split"))


@query("c37_slugs", "SELECT doc_id, concat('reg://', regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), '/para', CAST(topic AS STRING)) AS uri FROM {a_documents}")
def _(t):
    return t.a_documents.select("doc_id", F.concat(F.lit("reg://"), X.slug(c("title")), F.lit("/para"), c("topic").cast("string")).alias("uri"))


@query("c40_hashes", "SELECT doc_id, substr(sha256(text), 1, 16) AS id, sha1(text) AS digest FROM {documents}")
def _(t):
    return t.documents.select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("id"), F.sha1("text").alias("digest"))


@query("c41_json_default", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), -1) AS k FROM {events}")
def _(t):
    return t.events.select("event_id", F.coalesce(F.from_json("props", "k int")["k"], F.lit(-1)).alias("k"))


@query("c42_entropy_sigmoid", "SELECT vec_id, round(-(p * log2(p) + (1 - p) * log2(1 - p)), 9) AS entropy, round(1 / (1 + exp(-least(greatest(label - 4.5, -30), 30))), 9) AS sigmoid FROM (SELECT vec_id, label, (label + 1) / CAST(12 AS DOUBLE) AS p FROM {embeddings}) x")
def _(t):
    p = (c("label") + 1) / 12.0
    z = F.least(F.greatest(c("label") - 4.5, F.lit(-30.0)), F.lit(30.0))
    return t.embeddings.select("vec_id", F.round(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)), 9).alias("entropy"), F.round(1 / (1 + F.exp(-z)), 9).alias("sigmoid"))


@query("c43_display", "SELECT rule_id, concat(CASE operator WHEN '<=' THEN '≤' WHEN '>=' THEN '≥' WHEN 'within_days' THEN 'within' ELSE operator END, ' ', CAST(CAST(threshold AS INT) AS STRING), CASE WHEN unit = '%' THEN '%' ELSE concat(' ', unit) END) AS shown FROM {a_rules}")
def _(t):
    op = F.when(c("operator") == "<=", "≤").when(c("operator") == ">=", "≥").when(c("operator") == "within_days", "within").otherwise(c("operator"))
    return t.a_rules.select("rule_id", F.concat(op, F.lit(" "), c("threshold").cast("int").cast("string"), F.when(c("unit") == "%", "%").otherwise(F.concat(F.lit(" "), "unit"))).alias("shown"))


@query("c45_context_prefix", "SELECT doc_id, concat_ws(' | ', title, label, CASE WHEN topic > 3 THEN concat('para ', CAST(topic AS STRING)) END) AS prefix FROM {a_documents}")
def _(t):
    return t.a_documents.select("doc_id", F.concat_ws(" | ", "title", "label", F.when(c("topic") > 3, F.concat(F.lit("para "), c("topic").cast("string")))).alias("prefix"))


@query("c46_coercion", "SELECT id, lower(trim(x)) IN ('1', 'true', 'yes', 'y') AS flag, TRY_CAST(trim(x) AS DOUBLE) AS number FROM (VALUES (1, 'Yes'), (2, ' 1 '), (3, 'no'), (4, '2.5'), (5, 'TRUE'), (6, '')) v(id, x)")
def _(t):
    rows = t.spark.createDataFrame(list(enumerate(("Yes", " 1 ", "no", "2.5", "TRUE", ""), 1)), "id int, x string")
    return rows.select("id", F.lower(F.trim("x")).isin("1", "true", "yes", "y").alias("flag"), F.trim("x").try_cast("double").alias("number"))


# --- sources and chunks ----------------------------------------------------------------------------------------


_EDGES = "SELECT doc_id, source, regexp_replace(string_split(text, chr(10))[1], '[0-9]+', '#', 'g') AS top, regexp_replace(string_split(text, chr(10))[len(string_split(text, chr(10)))], '[0-9]+', '#', 'g') AS bottom, len(string_split(text, chr(10))) AS n FROM {documents}"


@query("s03_running_lines", f"""
SELECT p.doc_id, n - CASE WHEN t.k IS NULL THEN 0 ELSE 1 END - CASE WHEN b.k IS NULL OR n = 1 THEN 0 ELSE 1 END AS kept
FROM ({_EDGES}) p JOIN (SELECT source, count(*) AS pages FROM {{documents}} GROUP BY source) s USING (source)
LEFT JOIN (SELECT source, top AS line, count(*) AS k FROM ({_EDGES}) e GROUP BY ALL) t ON t.source = p.source AND t.line = p.top AND t.k >= 2 AND t.k >= 0.03 * pages
LEFT JOIN (SELECT source, bottom AS line, count(*) AS k FROM ({_EDGES}) e GROUP BY ALL) b ON b.source = p.source AND b.line = p.bottom AND b.k >= 2 AND b.k >= 0.03 * pages""")
def _(t):
    from ..operators.layout import without_running_lines

    pages = t.documents.select("doc_id", "source", F.split("text", "\n").alias("lines"))
    return without_running_lines(pages, "source", "lines", 2, 0.03).select("doc_id", F.size("lines").cast("long").alias("kept"))


@query("s02_layout_lines", "SELECT page, said FROM (VALUES (1, 'Capital ratio | 12.5%'), (1, 'Note on terms'), (2, 'Next page')) v(page, said)")
def _(t):
    from ..operators.layout import layout_rows

    spans = [(1, 10.0, 60.0, 100.0, "Capital"), (1, 62.0, 90.0, 100.8, "ratio"), (1, 130.0, 160.0, 99.5, "12.5%"), (1, 10.0, 30.0, 120.0, "Note"), (1, 31.0, 60.0, 120.0, "on terms"), (1, 61.0, 63.0, 120.0, "•"), (2, 10.0, 60.0, 100.0, "Next page")]
    return layout_rows(t.spark.createDataFrame(spans, "page int, x0 double, x1 double, y double, text string"), "page", 2.8, 11.0).select("page", "said")


@query("s04_footnotes", "SELECT line, footnote FROM (VALUES (1, false), (2, false), (3, false), (4, true), (5, true)) v(line, footnote)")
def _(t):
    from ..operators.layout import footnotes

    lines = [(1, 1, 10.0, 100.0, "1 Scope"), (1, 2, 7.0, 300.0, "2 small print above"), (1, 3, 10.0, 500.0, "body"), (1, 4, 7.0, 700.0, "1 See the Act"), (1, 5, 7.0, 710.0, "as amended")]
    rows = t.spark.createDataFrame(lines, "page int, line int, size double, y double, text string")
    return footnotes(rows, "page", 10.0, 800.0).select("line", "footnote")


@query("s09_text_pages", "SELECT doc_id, page, count(*) AS lines FROM (SELECT doc_id, (i - 1) // 20 + 1 AS page FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM {documents}) x) y GROUP BY ALL")
def _(t):
    from ..sources.readers import text_pages

    return text_pages(t.documents, "doc_id", "text", 20).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("lines"))


@query("s10_html_lines")
def _(t):
    return t.pages.select("page_id", F.posexplode(X.html_lines(c("html"))).alias("line_no", "line"))


@query("s17_page_links", r"""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM {pages}""")
def _(t):
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("link"))


@query("s11_json_metrics", "SELECT event_id, 'k' AS metric, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM {events} WHERE json_extract_string(props, '$.k') IS NOT NULL")
def _(t):
    from ..sources.readers import json_metrics

    return json_metrics(t.events, "event_id", "props")


@query("s25_postings_index")
def _(t):
    return T.postings(t.a_chunks)


@query("k01_k03_chunks")
def _(t):
    parts = X.packed(F.flatten(F.transform(X.sub_clauses(c("text")), X.sentences)), 1100)
    return t.documents.select("doc_id", F.posexplode(F.when(F.length("text") <= 1400, F.array("text")).otherwise(parts)).alias("chunk_index", "chunk"))
