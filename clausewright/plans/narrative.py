"""Titles, plain wording, profiles, passages, answers, segments, routed runs and report figures as named queries.

Queries over literal wordings state the readings that are right as values; they share nothing with the engine's patterns.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import naming as N
from ..functions import plainer as P
from ..operators import answering as A
from ..operators import disclosure as D
from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import passages as X
from ..operators import retrieval as T
from ..operators import routing as M
from ..operators import segments as S
from .analytics import _A, _B, _CASE_FEATURES, _G, _ROUTE_SQL, _TOTALS, COSTS
from .registry import query

c = F.col

_TITLES = [
    (1, "Reserve Bank of India (Small Finance Banks – Licensing) Guidelines, 2025"),
    (2, "Reserve Bank of India (Commercial Banks – Credit Risk Management) Directions, 2025"),
    (3, "Master Direction on Fraud Risk Management in Non-Banking Financial Companies"),
    (4, "Master Direction – Know Your Customer for all Regulated Entities"),
    (5, "Circular on green deposits"),
]


def _titles(t):
    return t.spark.createDataFrame(_TITLES, "id int, title string")


@query("c14_title_category", "SELECT id, category FROM (VALUES (1, 'small_finance_banks'), (2, 'commercial_banks'), (3, 'nbfc'), (4, 'multiple'), (5, NULL)) v(id, category)")
def _(t):
    return _titles(t).select("id", N.title_category(c("title")).alias("category"))


_APPLIES = [
    (1, "All Scheduled Commercial Banks {including Small Finance Banks (SFBs) and excluding Regional Rural Banks (RRBs)}"),
    (2, "All banks other than Payments Banks"),
    (3, "(excluding Payments Banks and Local Area Banks) and all NBFCs"),
    (4, "Urban Co-operative Banks except those named, including Primary Dealers"),
    (5, "Nobody in particular"),
]


@query("c14_covered_categories", "SELECT id, category FROM (VALUES (1, 'commercial_banks'), (1, 'small_finance_banks'), (3, 'nbfc'), (4, 'urban_cooperative_banks'), (4, 'primary_dealers')) v(id, category)")
def _(t):
    return t.spark.createDataFrame(_APPLIES, "id int, text string").select("id", F.explode(N.covered_categories(c("text"))).alias("category"))


@query("c15_topics", """SELECT id, topic, family FROM (VALUES (1, 'Licensing', 'licensing'), (2, 'Credit Risk Management', 'credit_risk'), (3, 'Fraud Risk Management', 'fraud_risk'),
(4, 'Know Your Customer for all Regulated Entities', 'kyc_aml'), (5, 'Circular on green deposits', 'deposits'), (5, 'Circular on green deposits', 'climate')) v(id, topic, family)""")
def _(t):
    said = _titles(t).withColumn("topic", N.topic(c("title")))
    return said.select("id", "topic", F.explode(N.topic_families(c("title"), c("topic"))).alias("family"))


@query("c16_covered_by_document", """SELECT id, category, source FROM (VALUES (1, 'small_finance_banks', 'title'), (1, 'payments_banks', 'hint'), (2, 'multiple', 'inferred'), (2, 'commercial_banks', 'applicability'), (2, 'nbfc', 'applicability'),
(3, 'multiple', 'inferred'), (4, 'local_area_banks', 'hint')) v(id, category, source)""")
def _(t):
    rows = [
        (1, "Reserve Bank of India (Small Finance Banks – Licensing) Guidelines", "payments_banks", ["These Directions shall be applicable to all NBFCs."], ""),
        (2, "On risk", None, ["Preface.", "These directions   shall apply to Commercial Banks and NBFCs."], ""),
        (3, "On risk", None, ["NBFCs are named here, but not as addressees."], "All concerned"),
        (4, "On risk", "local_area_banks", ["These directions shall apply to NBFCs."], ""),
    ]
    said = t.spark.createDataFrame(rows, "id int, title string, hint string, paragraphs array<string>, preamble string")
    return said.select("id", F.inline(N.categories(c("title"), c("hint"), N.applicability(c("paragraphs"), c("preamble")))))


@query("c16_addressees", "SELECT id, said FROM (VALUES (1, 'All Urban Co-operative Banks'), (2, 'These Directions shall apply to all NBFCs.'), (3, '')) v(id, said)")
def _(t):
    rows = [(1, ["One."], "All Urban Co-operative Banks Madam / Sir, please note"), (2, ["Scope. These Directions  shall apply to all NBFCs."], "No letter"), (3, None, None)]
    said = t.spark.createDataFrame(rows, "id int, paragraphs array<string>, preamble string")
    return said.select("id", F.trim(N.applicability(F.coalesce("paragraphs", F.array().cast("array<string>")), c("preamble"))).alias("said"))


@query("c17_headers", "SELECT id, reference, date, department, updated FROM (VALUES (1, 'RBI/DOR/2025-26/123', 'October 17, 2025', 'DOR.CRE.REC.No.1/07.10.002/2025-26', 'March 1, 2026'), (2, '', '', '', '')) v(id, reference, date, department, updated)")
def _(t):
    rows = [(1, "RBI/DOR/2025-26/123 DOR.CRE.REC.No.1/07.10.002/2025-26 October 17, 2025\nDirections (Updated as on March 1, 2026)"), (2, "Nothing")]
    said = t.spark.createDataFrame(rows, "id int, text string")
    return said.select("id", *[x.alias(name) for name, x in N.header(c("text")).items()])


_COVER = [
    ("a", 1, 1, "RESERVE BANK OF INDIA", 72.0, 14.0, True), ("a", 1, 2, "RBI/2025-26/9", 72.0, 11.0, True), ("a", 1, 3, "Master Direction – Reserve Bank of India (Banks – Risk)", 72.0, 12.0, True),
    ("a", 1, 4, "Directions, 2025", 72.0, 12.0, True), ("a", 1, 5, "Chapter I – Preliminary", 72.0, 12.0, True), ("a", 1, 6, "1. These Directions apply", 72.0, 11.0, False), ("a", 1, 7, "to all banks.", 90.0, 11.0, False),
    ("a", 1, 8, "2. A bank shall hold", 72.0, 11.0, False), ("a", 1, 9, "5 per cent of it, see paragraph", 72.0, 11.0, False), ("a", 1, 10, "4. of the Act.", 72.0, 11.0, False), ("a", 2, 1, "3. More.", 72.0, 11.0, False),
    ("a", 2, 2, "1. in a table", 140.0, 9.0, False), ("a", 2, 3, "Chapter II", 72.0, 12.0, True), ("a", 2, 4, "1. Anew.", 72.0, 11.0, False), ("a", 2, 5, "Annex I", 72.0, 12.0, True), ("a", 2, 6, "1. Form.", 72.0, 11.0, False),
    ("b", 1, 1, "1.1 First", 72.0, 11.0, False), ("b", 1, 2, "2.5 per cent is text", 72.0, 11.0, False), ("b", 1, 3, "1.2 Second", 72.0, 11.0, False), ("b", 1, 4, "2. Third", 72.0, 11.0, False),
]


def _cover(t):
    return t.spark.createDataFrame(_COVER, "document string, page int, line int, text string, x0 double, size double, bold boolean")


@query("c17_bold_titles", "SELECT 'a' AS document, 'Reserve Bank of India (Banks – Risk) Directions, 2025' AS title")
def _(t):
    return S.bold_titles(_cover(t))


@query("s05_segments", """SELECT document, place, kind, key, lines FROM (VALUES ('a', 0, 'preamble', '', 4), ('a', 1, 'chapter', 'Chapter I – Preliminary', 1), ('a', 2, 'paragraph', '1', 2), ('a', 3, 'paragraph', '2', 3), ('a', 4, 'paragraph', '3', 2),
('a', 5, 'chapter', 'Chapter II', 1), ('a', 6, 'paragraph', '1.1', 1), ('a', 7, 'annex', 'Annex I', 2), ('b', 0, 'paragraph', '1.1', 2), ('b', 1, 'paragraph', '1.2', 1), ('b', 2, 'paragraph', '2', 1)) v(document, place, kind, key, lines)""")
def _(t):
    return S.segments(_cover(t)).select("document", "place", "kind", "key", F.size(F.split("text", "\n")).alias("lines"))


@query("s05_no_text_lost", "SELECT source, length(string_agg(text, '')) AS characters FROM (SELECT source, trim(unnest(string_split(coalesce(text, ''), chr(10))), ' ') AS text FROM {documents}) x GROUP BY source")
def _(t):
    lines = t.documents.select(c("doc_id").alias("document"), F.lit(1).alias("page"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    cut = S.segments(lines.select("*", F.lit(72.0).alias("x0"), F.lit(11.0).alias("size"), F.lit(False).alias("bold")).withColumn("text", F.trim("text")))
    sized = cut.select(c("document").alias("doc_id"), F.length(F.replace("text", F.lit("\n"))).alias("n"))
    return sized.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("n").alias("characters"))


_WORDY = [
    (1, "In terms of section 4, a bank shall furnish the return prior to 30 days (refer Annex II)."),
    (2, "The bank is required to hold fifty per cent of RWAs; (b) it shall not commence business unless it is licensed."),
    (3, "The ratio shall mean the share held."),
    (4, "The bank shall maintain a policy for every branch and for each office that it runs in the country, and it shall review that policy with the board at least once in 2 years."),
]


@query("c32_simplified", """SELECT id, place, said, kept FROM (VALUES (1, 0, 'Under section 4, a bank must give the return before 30 days.', false), (2, 0, 'The bank must hold 50% of risk-weighted assets (RWAs).', false),
(2, 1, '(b) it must not start business unless it is licensed.', false), (3, 0, 'The ratio shall mean the share held.', true),
(4, 0, 'The bank must maintain a policy for every branch and for each office that it runs in the country.', false), (4, 1, 'It must review that policy with the board at least once in 2 years.', false)) v(id, place, said, kept)""")
def _(t):
    rows = t.spark.createDataFrame(_WORDY, "id int, text string")
    return rows.select("id", F.posexplode(P.simplified(c("text"))).alias("place", "s")).select("id", "place", "s.said", "s.kept")


@query("c33_meaning_kept", "SELECT id, kept FROM (VALUES (1, true), (2, false), (3, false), (4, false), (5, true), (6, false), (7, false)) v(id, kept)")
def _(t):
    from ..functions.text import meaning_kept

    rows = [(1, "It shall pay 5 per cent.", "It must pay 5%."), (2, "It shall pay 5 days.", "It must pay 5%."), (3, "It shall not pay.", "It must pay."), (4, "It shall pay unless ill.", "It must pay."), (5, "Notwithstanding this it is required to pay.", "Despite this it must pay."), (6, "It shall pay.", "It pays."), (7, "It pays.", "It pays 3.")]
    return t.spark.createDataFrame(rows, "id int, a string, b string").select("id", meaning_kept(c("a"), c("b")).alias("kept"))


_PAGES = [
    ("x", 1, ["Annual Report 2024-25", "HDFC Bank Ltd.", "The Board of HDFC Bank met"]),
    ("x", 2, ["the quarter ended June 30, 2024 and as on 31st March, 2025", "As at 31.03.2025 the Reserve Bank said", "significant accounting policies"]),
    ("y", 1, ["Ujjivan Small Finance Bank Limited", "Pillar 3 disclosure, Sep 30, 2024"]),
    ("y", 2, ["DF-3 of the bank"]),
    ("z", 1, ["Annual report 2022-23"]),
    ("w", 1, ["nothing here"]),
]


@query("d05_profiles", """SELECT document, bank_name, category, as_of, period, kind, dsib FROM (VALUES ('x', 'HDFC Bank Limited', 'commercial_banks', DATE '2025-03-31', 'Q4-FY2024-25', 'annual_report', true),
('y', 'Ujjivan Small Finance Bank Limited', 'small_finance_banks', DATE '2024-09-30', 'Q2-FY2024-25', 'pillar3', false), ('z', NULL, NULL, DATE '2023-03-31', 'Q4-FY2022-23', 'annual_report', false), ('w', NULL, NULL, NULL, NULL, 'other', false)) v(document, bank_name, category, as_of, period, kind, dsib)""")
def _(t):
    return X.profiles(t.spark.createDataFrame(_PAGES, "document string, page int, lines array<string>"))


_STORY = "The audit committee of the board reviews the risk based internal audit plan in every quarter of the year, and it takes note of what was found and what was done about it since."


@query("d10_governance_passages", "SELECT document, page, place, length, hits, subjects FROM (VALUES ('x', 1, 0, 351, 8, 1), ('x', 1, 1, 175, 4, 1), ('x', 2, 0, 173, 4, 1)) v(document, page, place, length, hits, subjects)")
def _(t):
    rows = [("x", 1, ["Running head of it", _STORY, _STORY, _STORY, "a | table"]), ("x", 2, ["Running head of it", _STORY.replace("quarter", "month"), "12 34"]), ("x", 3, ["Running head of it", "A short audit line."]), ("v", 1, ["Weather was fine and the harvest was good in all the places that we have seen this year, so that nobody had anything to say about it for a long time and all went home early."])]
    found = X.governance_passages(t.spark.createDataFrame(rows, "document string, page int, lines array<string>"))
    return found.select("document", "page", "place", F.length("text").alias("length"), "hits", F.size("subjects").alias("subjects"))


@query("d11_obligations_addressed", """
WITH n AS (SELECT p.vec_id AS passage, p.vec_id // 300 AS document, p.label AS pl, o.vec_id AS clause, o.label AS ol, round(list_dot_product(CAST(p.embedding AS DOUBLE[]), CAST(o.embedding AS DOUBLE[])), 9) AS score
  FROM {embeddings} p JOIN {embeddings} o ON o.vec_id % 100 <> 0 WHERE p.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY p.vec_id ORDER BY score DESC, concat('c', o.vec_id)) <= 5),
b AS (SELECT document, clause, passage, score FROM n WHERE score >= 0.1 AND pl % 2 = ol % 2 AND clause % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY document, clause ORDER BY score DESC, passage) = 1)
SELECT document, clause, passage, score FROM b QUALIFY row_number() OVER (PARTITION BY document ORDER BY score DESC, clause) <= 15""")
def _(t):
    said = F.array((c("label") % 2).cast("string"))
    passages = t.embeddings.where("vec_id % 100 = 0").select(F.floor(c("vec_id") / 300).alias("document"), c("vec_id").alias("passage"), c("embedding").alias("vector"), said.alias("subjects"))
    clauses = t.embeddings.where("vec_id % 100 <> 0").select(c("vec_id").alias("clause"), c("embedding").alias("vector"), said.alias("subjects"), (c("vec_id") % 5 != 0).alias("eligible"))
    return X.obligations_addressed(passages, clauses, least=0.1)


# --- answers -----------------------------------------------------------------------------------------------------

_QUESTIONS = "question int, smalltalk boolean, limited boolean, defines boolean"
_RESULTS = "question int, clause string, place int, semantic double, coverage double"


@query("r09_answer_states", """SELECT question, mode, confidence, fallbacks, clauses FROM (VALUES (1, 'smalltalk', 'low', '', ''), (2, 'extractive', 'high', '', 'a,b'), (3, 'extractive', 'medium', 'wider', 'w'), (4, 'not_found', 'low', '', ''),
(5, 'not_found', 'low', '', ''), (6, 'extractive', 'medium', 'definitions', 'a,b,c,d,e,f,y,z'), (7, 'extractive', 'medium', '', 'a')) v(question, mode, confidence, fallbacks, clauses)""")
def _(t):
    made = t.spark.createDataFrame
    asked = made([(1, True, False, False), (2, False, False, False), (3, False, True, False), (4, False, False, False), (5, False, True, False), (6, False, False, True), (7, False, False, True)], _QUESTIONS)
    narrow = made([(2, "a", 1, 0.8, 0.6), (2, "b", 2, 0.7, 0.6), (3, "n", 1, 0.3, 0.1), (4, "n", 1, 0.5, 0.2), *[(6, x, i + 1, 0.65, 0.2) for i, x in enumerate("abcdefgh")], (7, "a", 1, 0.65, 0.2)], _RESULTS)
    wide = made([(3, "w", 1, 0.7, 0.4), (5, "w", 1, 0.1, 0.1)], _RESULTS)
    defined = made([(6, "y"), (7, "a"), (2, "q")], "question int, clause string")
    extra = made([(6, "y", 1), (6, "a", 2), (6, "z", 3), (6, "late", 4), (7, "k", 1)], "question int, clause string, place int")
    found = A.answers(asked, narrow, wide, defined, extra)
    return found.select("question", "mode", "confidence", F.array_join("fallbacks", ",").alias("fallbacks"), F.array_join("clauses", ",").alias("clauses"))


@query("r09_standalone_questions", "SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)^(and|then|is it|it|this|that|these|those|for) ') AND before IS NOT NULL THEN text || ' (context: ' || before || ')' ELSE text END AS question FROM (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM {conversations} WHERE role = 'user') x WHERE NOT regexp_matches(text, '(?i)^(and|also|then|for)[^ ]')")
def _(t):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    users = t.conversations.where("role = 'user'").withColumn("before", before)
    return users.where(~c("text").rlike("(?i)^(?:and|also|then|for)[^ ]")).select("conv_id", "turn", A.standalone(c("text"), c("before")).alias("question"))


@query("r02_stemmed_bm25")
def _(t):
    return A.stemmed_bm25(t.a_chunks, t.a_questions).select("question_id", "chunk_id", F.round("score", 6).alias("score"))


_COVER_SQL = "(contains(lower(text), 'ing')::INT + contains(lower(text), 'zzz')::INT + contains(lower(text), 'the')::INT) / 3.0"


@query("j24_hits_with_text", f"SELECT vec_id, doc_id, place FROM (SELECT h.vec_id, d.doc_id, row_number() OVER (PARTITION BY h.label ORDER BY {_COVER_SQL} DESC, h.place) AS place FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM {{embeddings}}) h JOIN {{documents}} d ON d.doc_id = h.vec_id) x")
def _(t):
    hits = t.embeddings.select("vec_id", "label", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("place"))
    cover = T.coverage(c("text"), F.array(*map(F.lit, ("ing", "zzz", "the"))))
    texts = hits.join(t.documents.select("doc_id", "text"), c("vec_id") == c("doc_id")).withColumn("cover", cover)
    return texts.select("vec_id", "doc_id", F.row_number().over(Window.partitionBy("label").orderBy(c("cover").desc(), "place")).alias("place"))


# --- routed runs and figures -------------------------------------------------------------------------------------

_USD = "CASE route WHEN 'RAG_LLM' THEN ((600 + prompt_chars / 4) * 0.3 + 1000) / 1000000 WHEN 'HUMAN' THEN 1.5 ELSE 0.0 END"


@query("m12_routed_run", f"""
SELECT case_id, route, CASE WHEN evidence = 0 THEN 'INSUFFICIENT_DATA' WHEN route = 'HUMAN' THEN 'REQUIRES_HUMAN_REVIEW' WHEN route = 'DETERMINISTIC' THEN CASE WHEN prompt_chars % 2 = 0 THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END WHEN prompt_chars % 11 = 0 THEN 'REQUIRES_HUMAN_REVIEW' ELSE 'AMBIGUOUS' END AS decision,
       CASE WHEN evidence = 0 THEN 'no evidence' WHEN evidence < 0.4 THEN 'too little evidence' WHEN applicable AND evidence = 1 AND NOT conflict THEN 'the rule engine applies' ELSE 'least expected cost' END AS reason, round({_USD}, 9) AS usd
FROM (SELECT *, {_ROUTE_SQL} AS route FROM ({_CASE_FEATURES}) x) y""")
def _(t):
    n = c("prompt_chars")
    found = {"DETERMINISTIC": F.when(n % 2 == 0, "COMPLIANT").otherwise("NON_COMPLIANT"), "RAG_LLM": F.when(n % 11 != 0, "AMBIGUOUS")}
    return M.routed_run(t.sql(_CASE_FEATURES), COSTS, (_A, _B, _G), 0.4, found).select("case_id", "route", "decision", "reason", F.round("usd", 9).alias("usd"))


@query("a16_route_metrics", """
SELECT rule_type, count(*) AS n, round(avg((gold = pred)::INT), 9) AS accuracy, round(avg((gold = pred OR route = 'HUMAN')::INT), 9) AS end_to_end,
       round(coalesce(count(*) FILTER (gold = 'COMPLIANT' AND pred = 'NON_COMPLIANT') / nullif(count(*) FILTER (gold = 'COMPLIANT'), 0), 0), 9) AS false_positives,
       round(coalesce(count(*) FILTER (gold = 'NON_COMPLIANT' AND pred <> 'NON_COMPLIANT' AND route <> 'HUMAN') / nullif(count(*) FILTER (gold = 'NON_COMPLIANT'), 0), 0), 9) AS false_negatives,
       round(avg((route = 'HUMAN')::INT), 9) AS escalated, round(avg((route = 'RAG_LLM')::INT), 9) AS model_calls,
       round(coalesce(count(*) FILTER (route <> 'HUMAN' AND cost % 4 > 0) / nullif(count(*) FILTER (route <> 'HUMAN'), 0), 1), 9) AS cited
FROM {a_cases} GROUP BY rule_type""")
def _(t):
    found = E.route_metrics(t.a_cases.withColumn("cited_right", c("cost") % 4 > 0), ["rule_type"])
    return found.select("rule_type", "n", *[F.round(x, 9).alias(x) for x in found.columns[2:]])


_FAMILY_ROWS = """
SELECT user_id AS bank, CASE event_id % 4 WHEN 0 THEN 'rule' WHEN 1 THEN 'disclosure' WHEN 2 THEN 'qualitative' ELSE 'network' END AS family,
       CASE event_id % 4
         WHEN 0 THEN CASE event_id % 52 WHEN 0 THEN CASE WHEN user_id % 3 = 0 THEN 'BREACH' ELSE 'PASS' END WHEN 4 THEN 'BUFFER_SHORTFALL' WHEN 8 THEN 'TARGET_SHORTFALL' WHEN 12 THEN 'NOT_DISCLOSED' WHEN 16 THEN 'CANDIDATE' WHEN 20 THEN 'NEEDS_REVIEW' WHEN 24 THEN 'NOT_REPORTED' ELSE 'PASS_WITH_CONDITIONS' END
         WHEN 1 THEN CASE WHEN event_id % 5 = 0 THEN 'LIKELY_MISSING' ELSE 'PRESENT' END
         WHEN 2 THEN CASE event_id % 3 WHEN 0 THEN 'COVERED' WHEN 1 THEN 'PARTIAL' ELSE 'EVIDENCE_FOUND' END
         ELSE CASE WHEN event_id % 91 = 3 THEN 'PROHIBITED' WHEN event_id % 7 = 0 THEN 'POTENTIAL_BREACH' ELSE 'PASS' END END AS status
FROM {events}"""


@query("a11_a12_report_counts", f"""
SELECT *, CASE WHEN breaches + network_breaches > 0 THEN 'BREACH' WHEN buffer_shortfalls + target_shortfalls + needs_review + items_missing + network_attention > 0 THEN 'ATTENTION' WHEN rules_checked > not_disclosed + candidates THEN 'PASS' ELSE 'INSUFFICIENT_DATA' END AS overall FROM (
  SELECT bank, count(*) FILTER (family = 'rule') AS rules_checked, count(*) FILTER (family = 'rule' AND status LIKE 'PASS%') AS rules_passed, count(*) FILTER (family = 'rule' AND status = 'BREACH') AS breaches,
    count(*) FILTER (status = 'BUFFER_SHORTFALL') AS buffer_shortfalls, count(*) FILTER (status = 'TARGET_SHORTFALL') AS target_shortfalls, count(*) FILTER (status IN ('NOT_DISCLOSED', 'NOT_REPORTED')) AS not_disclosed, count(*) FILTER (status = 'CANDIDATE') AS candidates,
    count(*) FILTER (family = 'disclosure') AS items_checked, count(*) FILTER (status = 'PRESENT') AS items_present, count(*) FILTER (status = 'LIKELY_MISSING') AS items_missing,
    count(*) FILTER (family = 'qualitative') AS obligations_matched, count(*) FILTER (status = 'COVERED') AS obligations_covered, count(*) FILTER (status = 'PARTIAL') AS obligations_partial,
    count(*) FILTER (family = 'network') AS network_checked, count(*) FILTER (family = 'network' AND status = 'PROHIBITED') AS network_breaches, count(*) FILTER (family = 'network' AND status = 'POTENTIAL_BREACH') AS network_attention,
    count(*) FILTER (status = 'NEEDS_REVIEW') AS needs_review FROM ({_FAMILY_ROWS}) x GROUP BY bank) y""")
def _(t):
    return D.report_summary(t.sql(_FAMILY_ROWS), "bank")


@query("a28_largest_exposures", f"SELECT entity_id, total + exempt AS exposure FROM ({_TOTALS}) y WHERE total + exempt > 0 ORDER BY exposure DESC, entity_id LIMIT 20")
def _(t):
    totals = G.aggregate_exposures(t.a_exposures, t.a_entities).select("entity_id", (c("total") + c("exempt")).alias("exposure"))
    return totals.where("exposure > 0").orderBy(c("exposure").desc(), "entity_id").limit(20)


@query("a28_overall_status", "SELECT bank, arg_min(status, s) AS overall FROM (SELECT *, CASE status WHEN 'PROHIBITED' THEN 0 WHEN 'POTENTIAL_BREACH' THEN 2 ELSE 7 END AS s FROM (" + _FAMILY_ROWS + ") x WHERE family = 'network') y GROUP BY bank")
def _(t):
    from ..functions.numbers import severity

    return t.sql(_FAMILY_ROWS).where("family = 'network'").groupBy("bank").agg(F.min_by("status", severity(c("status"))).alias("overall"))


_SIMPLER = "SELECT case_id, rule_type, CASE WHEN cost % 7 > 0 THEN CAST(cost % 19 AS DOUBLE) END AS grade_before, CASE WHEN cost % 5 > 0 THEN CAST(cost % 13 AS DOUBLE) END AS grade_after, cost % 3 > 0 AS guard, cost % 2 = 0 AS had_rules, cost % 8 > 0 AS same_rules, cost % 4 AS verbatim, cost % 4 + 1 AS sentences FROM {a_cases}"


@query("a30_simplification_means", f"""
SELECT rule_type, count(*) AS n, round(avg(grade_before) FILTER (grade_after IS NOT NULL), 9) AS grade_before, round(avg(grade_after) FILTER (grade_before IS NOT NULL), 9) AS grade_after, round(avg(guard::INT), 9) AS guard_pass,
       round(avg(same_rules::INT) FILTER (had_rules), 9) AS rule_agreement, round(sum(verbatim) / sum(sentences), 9) AS verbatim_share FROM ({_SIMPLER}) x GROUP BY rule_type""")
def _(t):
    found = E.simplification_means(t.sql(_SIMPLER), "rule_type")
    return found.select("rule_type", "n", *[F.round(x, 9).alias(x) for x in found.columns[2:]])


_EVIDENCE = [
    (1, "A", False, ["crar"], ["crar"], 0.9, True, "high", False, "However, the ratio was not met."),
    (2, "C", True, ["crar"], ["crar"], 0.7, True, "low", True, "A plan, in due course."),
    (3, "G", False, ["crar"], ["crar"], 1.4, False, None, False, ""),
    (4, "B", False, ["requirement_met", "narrative"], [], 0.6, False, "medium", False, "Done."),
    (5, "E", True, ["narrative"], [], None, None, "medium", None, None),
]


@query("m01_feature_vector", """SELECT id, type_a, reading, structured, confidence, engine, completeness, risk, narrative, contradicted, uncertain FROM (VALUES (1, 1::DOUBLE, 0::DOUBLE, 1::DOUBLE, 0.9::DOUBLE, 1::DOUBLE, 1::DOUBLE, 3::DOUBLE, 1::DOUBLE, 1::DOUBLE, 0::DOUBLE),
(2, 0, 1, 0.5, 0.7, 0, 0.75, 1, 1, 0, 1), (3, 0, 0, 0, 1, 0, 0, 2, 0, 0, 0), (4, 0, 0, 0, 0.6, 0, 0.75, 2, 1, 0, 0), (5, 0, 1, 0, 0, 0, 0, 2, 0, 0, 0)) v(id, type_a, reading, structured, confidence, engine, completeness, risk, narrative, contradicted, uncertain)""")
def _(t):
    rows = t.spark.createDataFrame(_EVIDENCE, "id int, rule_type string, reading boolean, needed array<string>, given array<string>, relevance double, number_in_text boolean, risk string, source_conflict boolean, narrative string")
    f = M.features(rows.withColumns({"history_rule": F.lit(0.9), "history_llm": F.lit(None).cast("double"), "number_in_text": F.coalesce("number_in_text", F.lit(False))}))
    names = {"type_a": "rule_type_A", "reading": "requires_semantic_interpretation", "structured": "structured_field_availability", "confidence": "retrieval_confidence", "engine": "rule_engine_applicability", "completeness": "evidence_completeness", "narrative": "narrative_present", "contradicted": "text_structured_conflict", "uncertain": "text_uncertainty_cue"}
    return f.select("id", *[c(x).alias(name) for name, x in names.items()], F.round(c("risk_level") * 3, 6).alias("risk"))


@query("c13_ranges_and_documents", "SELECT kind, target FROM (VALUES ('paragraph', '12'), ('range_end', '15'), ('paragraph', '3.1(a)'), ('annex', 'IV'), ('document', 'Reserve Bank of India (Commercial Banks (SCBs) – Risk) Directions, 2025')) v(kind, target)")
def _(t):
    from ..functions.text import cross_references

    said = t.spark.createDataFrame([("See paragraphs 12 to 15 and para 3.1(a) of Annex-IV of the Reserve Bank of India (Commercial Banks (SCBs) – Risk) Directions, 2025.",)], "text string")
    return said.select(F.inline(cross_references(c("text"))))


_DOC_FAMILIES = "SELECT doc_id, concat('topic ', CAST(topic AS STRING)) AS topic, doc_id % 3 AS f1, CASE WHEN doc_id % 4 = 0 THEN 3 END AS f2 FROM {a_documents}"


@query("a05_topic_families", f"""
SELECT family, CAST(sum(n) AS BIGINT) AS docs, string_agg(topic || ': ' || n, ', ' ORDER BY n DESC, topic) AS subtopics FROM (
  SELECT family, topic, count(*) AS n FROM (SELECT f1 AS family, topic FROM ({_DOC_FAMILIES}) a UNION ALL SELECT f2, topic FROM ({_DOC_FAMILIES}) b WHERE f2 IS NOT NULL) r GROUP BY family, topic) s GROUP BY family""")
def _(t):
    rows = t.sql(_DOC_FAMILIES).select("doc_id", "topic", F.explode(F.array_compact(F.array("f1", "f2"))).alias("family"))
    counts = rows.groupBy("family", "topic").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-c("n")).alias("down"), "topic", "n")))
    said = F.array_join(F.transform(listed, lambda x: F.concat(x["topic"], F.lit(": "), x["n"].cast("string"))), ", ")
    return counts.groupBy("family").agg(F.sum("n").alias("docs"), said.alias("subtopics"))


@query("w02_best_chunk_then_cap", "SELECT chunk, clause, doc FROM (SELECT vec_id AS chunk, vec_id // 3 AS clause, vec_id // 24 AS doc, label AS score FROM {embeddings} QUALIFY row_number() OVER (PARTITION BY vec_id // 3 ORDER BY label DESC, vec_id) = 1) x QUALIFY row_number() OVER (PARTITION BY doc ORDER BY score DESC, chunk) <= 3")
def _(t):
    chunks = t.embeddings.select(c("vec_id").alias("chunk"), F.floor(c("vec_id") / 3).alias("clause"), F.floor(c("vec_id") / 24).alias("doc"), c("label").alias("score"))
    best = chunks.groupBy("clause", "doc").agg(F.max_by(F.struct("chunk", "score"), F.struct("score", -c("chunk"))).alias("b")).select("clause", "doc", "b.*")
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(c("score").desc(), "chunk"))
    return best.withColumn("rank", rank).where("rank <= 3").select("chunk", "clause", "doc")


@query("a20_paired_difference", "SELECT round(sum((gold = pred OR route = 'HUMAN')::INT - (gold = pred)::INT) / count(*), 9) AS difference FROM {a_cases}")
def _(t):
    ok, better = c("gold") == c("pred"), (c("gold") == c("pred")) | (c("route") == "HUMAN")
    return t.a_cases.agg(F.round(F.sum(better.cast("int") - ok.cast("int")) / F.count(F.lit(1)), 9).alias("difference"))
