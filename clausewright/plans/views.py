"""Views that give the engine's operators inputs from the star-schema tables.

Each view is plain SQL that Spark and the checking engine both read; `{name}` stands for a table or view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "a_categories": "SELECT r_regionkey AS category, r_name AS label FROM {region}",
    "a_banks": "SELECT n_nationkey AS bank_id, n_name AS bank_name, n_regionkey AS category FROM {nation}",
    "a_documents": """
SELECT s_suppkey AS doc_id, s_name AS title, n_regionkey AS category, CAST(s_suppkey % 7 AS INT) AS topic,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE concat('v', CAST(s_suppkey % 3 AS STRING)) END AS label, s_acctbal AS size
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "a_doc_categories": """
SELECT doc_id, category, 'title' AS source FROM {a_documents}
UNION ALL SELECT doc_id, (category + 1) % 5 AS category, 'applicability' AS source FROM {a_documents} WHERE doc_id % 3 = 0""",
    "a_clauses": """
SELECT o_orderkey AS clause_id, doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o_orderdate, o_orderkey) AS INT) AS seq, role, ctype, page, page_end, text_length, deleted, variable
FROM (SELECT o_orderkey, o_orderdate, o_custkey % (SELECT count(*) FROM {supplier}) AS doc_id,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'obligation' WHEN '2-HIGH' THEN 'prohibition' WHEN '3-MEDIUM' THEN 'definition' WHEN '4-NOT SPECIFIED' THEN 'applicability' ELSE 'boilerplate' END AS role,
        CASE o_orderstatus WHEN 'O' THEN 'quantitative' WHEN 'F' THEN 'qualitative' ELSE 'relational' END AS ctype,
        CAST(o_orderkey % 40 AS INT) AS page, CAST(o_orderkey % 40 + o_orderkey % 3 AS INT) AS page_end,
        CAST(floor(o_totalprice) AS BIGINT) % 6000 AS text_length, o_orderkey % 11 = 0 AS deleted, concat('var_', CAST(o_orderkey % 50 AS STRING)) AS variable
      FROM {orders}) o""",
    "a_rules": """
SELECT p_partkey AS rule_id, p_partkey * 3 AS clause_id,
       CASE WHEN p_partkey % 97 = 0 THEN '??' WHEN p_partkey % 5 = 0 THEN '<=' WHEN p_partkey % 5 = 1 THEN '>=' WHEN p_partkey % 5 = 2 THEN '<' WHEN p_partkey % 5 = 3 THEN '>' ELSE 'within_days' END AS operator,
       CAST(p_size AS DOUBLE) AS threshold, CASE p_size % 3 WHEN 0 THEN '%' WHEN 1 THEN 'crore' ELSE 'days' END AS unit,
       CASE WHEN p_size % 2 = 0 THEN 'requirement' ELSE 'condition' END AS atom_kind,
       CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 'high' ELSE 'low' END AS confidence, p_name AS variable_text, p_brand AS brand
FROM {part}""",
    "a_reports": """
SELECT l_suppkey % 25 AS bank_id, l_partkey AS rule_id, year(l_shipdate) - CASE WHEN month(l_shipdate) < 4 THEN 1 ELSE 0 END AS fy,
       CAST(CASE WHEN month(l_shipdate) < 4 THEN 4 WHEN month(l_shipdate) < 7 THEN 1 WHEN month(l_shipdate) < 10 THEN 2 ELSE 3 END AS INT) AS quarter,
       l_quantity AS value, l_shipdate AS submitted_at, l_orderkey, l_linenumber, l_suppkey
FROM {lineitem}""",
    "a_submissions": """
SELECT bank_id, rule_id, fy, quarter, max_by(value, (submitted_at, l_orderkey, l_linenumber, l_suppkey, value)) AS value, max(submitted_at) AS submitted_at
FROM {a_reports} GROUP BY bank_id, rule_id, fy, quarter""",
    "a_history": "SELECT event_id, user_id AS bank_id, event_type AS rule, value, ts AS submitted_at FROM {events}",
    "a_mappings": "SELECT p_partkey AS rule_id, concat('label ', p_type) AS canonical_label, CASE WHEN p_partkey % 6 = 0 THEN 'approved' ELSE 'draft' END AS status FROM {part}",
    "a_references": """
SELECT o_orderkey AS ref_id, o_orderkey AS from_clause, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey * 7) % (SELECT count(*) FROM {orders}) END AS to_clause,
       CASE o_orderkey % 3 WHEN 0 THEN 'document' WHEN 1 THEN 'paragraph' ELSE 'annex' END AS ref_type FROM {orders}""",
    "a_footnotes": "SELECT o_orderkey AS footnote_id, o_custkey % (SELECT count(*) FROM {supplier}) AS doc_id, CAST(o_orderkey % 40 AS INT) AS page FROM {orders}",
    "a_versions": """
SELECT rule, effective_from, threshold FROM (
  SELECT event_type AS rule, CAST(ts AS DATE) AS effective_from, value AS threshold, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM {events}) x WHERE rn = 1""",
    "a_entities": """
SELECT c_custkey AS entity_id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'company' WHEN 'BUILDING' THEN 'nbfc' WHEN 'FURNITURE' THEN 'individual' WHEN 'HOUSEHOLD' THEN 'bank' ELSE 'sovereign' END AS entity_type,
       c_custkey % 10 = 0 AS gold_loan, c_acctbal AS balance FROM {customer}""",
    "a_edges": """
SELECT c_custkey AS from_entity, (c_custkey * 7 + 3) % (SELECT count(*) FROM {customer}) AS to_entity,
       CASE c_custkey % 8 WHEN 0 THEN 'OWNS' WHEN 1 THEN 'OWNS' WHEN 2 THEN 'CONTROLS' WHEN 3 THEN 'COMMON_MANAGEMENT' WHEN 4 THEN 'ECONOMIC_DEPENDENCE' WHEN 5 THEN 'DIRECTOR_OF' WHEN 6 THEN 'RELATIVE_OF' ELSE 'OWNS' END AS edge_type,
       CAST((c_custkey * 13) % 101 AS DOUBLE) AS pct, CASE c_custkey % 10 WHEN 0 THEN 'rebutted' WHEN 1 THEN 'flagged' ELSE 'confirmed' END AS status, c_custkey % 16 = 4 AS bidirectional
FROM {customer}""",
    "a_exposures": """
SELECT o_custkey AS entity_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'equity' WHEN '2-HIGH' THEN 'non_fund_based' WHEN '3-MEDIUM' THEN NULL ELSE 'fund_based' END AS kind,
       CAST(floor(o_totalprice) AS BIGINT) AS amount, CAST(floor(o_totalprice * 1.1) AS BIGINT) AS sanctioned, CASE WHEN o_orderkey % 7 = 0 THEN CAST(floor(o_totalprice / 3) AS BIGINT) END AS crm,
       CASE WHEN o_orderkey % 7 = 0 THEN (o_custkey + 1) % (SELECT count(*) FROM {customer}) END AS crm_provider, o_orderkey % 5 = 0 AS infrastructure,
       CASE WHEN o_orderkey % 23 = 0 THEN 'guaranteed' END AS exempt_reason, o_orderkey % 13 = 0 AS board_approved
FROM {orders}""",
    # Literal wordings, ours, one for each reading.
    "fx_clauses": """
SELECT clause_id, text FROM (VALUES
 (1, 'The exposure shall not exceed 20 per cent of Tier 1 capital.'), (2, 'A bank shall maintain a minimum of 9% of risk weighted assets.'),
 (3, 'Complaints must be closed within 30 days of receipt.'), (4, 'The loan may go up to Rs. 50 lakh for each borrower.'),
 (5, 'Leverage shall be at least 3 times the base.'), (6, '"Promoter" means a person named in paragraph 4(2) of Annex II.'),
 (7, 'A bank shall not lend against its own shares.'), (8, 'These directions shall apply to all payment banks.'),
 (9, 'Holdings below 10 per cent need no report.'), (10, 'Omitted with effect from 1 April.'),
 (11, 'The board should review the policy; see paragraph 12 and paragraph 13(a).'), (12, 'Fees of more than fifty per cent are unusual.'),
 (13, 'Banks may offer this facility to members.'), (14, 'The ratio is computed daily. It is shown in Annex 3.'), (15, 'This circular is for information.')) AS v(clause_id, text)""",
    "fx_values": """
SELECT id, x FROM (VALUES (1, '1,23,456.5'), (2, '(45.2)'), (3, '12 per cent'), (4, '7%'), (5, 'n/a'), (6, ' 1,000 '), (7, '(3)%')) AS v(id, x)""",
    "fx_dates": "SELECT id, x FROM (VALUES (1, '2024-03-31'), (2, '31-12-2023'), (3, '5 June 2022'), (4, 'March 7, 2021'), (5, 'soon')) AS v(id, x)",
    "fx_limits": """
SELECT id, text FROM (VALUES
 (1, 'The exposure to a single counterparty shall not exceed 20 per cent of the Tier 1 capital.'), (2, 'A bank shall maintain a minimum CRAR of 9 per cent.'),
 (3, 'Complaints must be closed within 30 working days of receipt.'), (4, 'If the ratio falls below 8 per cent, the bank shall not pay dividends.'),
 (5, 'Loans up to Rs. 50 lakh are exempt.'), (6, 'Banks shall lend up to Rs. 50 lakh to each borrower.'),
 (7, 'Gross NPA shall be not more than 5 per cent and 7 per cent of advances respectively.'), (8, 'Investments under HTM shall not exceed twenty-five per cent of total investments.'),
 (9, 'Minimum leverage ratio shall be 4 per cent.'), (10, 'Accounts of ₹ 5 crore or more need review.'), (11, 'No limit here.'),
 (12, 'The bank shall have a board approved policy on outsourcing.'), (13, 'Each group of connected counterparties shall be reviewed.'), (14, 'Loans to a director or a subsidiary shall be reported quarterly.'),
 (15, 'The bank shall maintain robust controls.')) AS v(id, text)""",
    "fx_figures": """
SELECT id, text FROM (VALUES
 (1, 'CRAR was 12.5% on June 30, 2025 against 11.5 per cent'), (2, 'Q1 FY25 loss (45.2) and 1,23,456.5 crore'), (3, 'dated 30.06.2025, 30/06/2025, 30th June and T-1'),
 (4, '-3.5 in 2024 and 2,024 and 2150'), (5, 'rows 12cr 15abc')) AS v(id, text)""",
    "fx_lines": """
SELECT page, line, text FROM (VALUES
 (1, 1, 'Annual report 2024-25'), (1, 2, 'Capital adequacy ratio (CRAR) stood at 14.25% as at March 31, 2025 (previous year 13.9%)'), (1, 3, 'CRAR of peers 250%'),
 (2, 1, 'Gross NPA ratio | 3.1% | 4.0%'), (2, 2, 'Net NPA ratio is not stated'), (3, 1, 'Net worth: ₹ 1,250.5 crore'), (3, 2, 'Net NPA 0.9 per cent'), (4, 1, 'Net worth rose to ₹ 2 lakh crore')) AS v(page, line, text)""",
    "fx_metrics": """
SELECT metric, label, exclude, unit, low, high, alias FROM (VALUES
 ('crar', '(capital adequacy ratio|CRAR)', 'peers', '%', 0.0, 100.0, 'capital adequacy'), ('gross_npa_ratio', '(gross NPA)', 'none', '%', 0.0, 100.0, 'gnpa'),
 ('net_npa_ratio', '(net NPA)', 'none', '%', 0.0, 100.0, 'nnpa'), ('net_worth', '(net worth)', 'none', 'crore', 0.0, 10000000.0, 'networth')) AS v(metric, label, exclude, unit, low, high, alias)""",
    "fx_evidence": """
SELECT id, clause, evidence, relevant FROM (VALUES
 (1, 'The ratio shall be at least 9 per cent.', 'CRAR stood at 10.2%.', true), (2, 'The ratio shall be at least 9 per cent.', 'It moved in a range of 8 to 10 per cent.', true),
 (3, 'Reply within 30 days.', 'Replies took 45 days.', true), (4, 'Have a policy.', 'The policy is in place.', true), (5, 'Have a policy.', 'No policy exists.', true),
 (6, 'Have a policy.', 'The policy is under preparation.', true), (7, 'Have a policy.', 'The policy exists. It was not approved.', true), (8, 'Have a policy.', 'Weather is fine.', false),
 (9, 'Have a policy.', 'The requirement is not applicable.', false), (10, 'Keep 4 per cent at least.', '', true)) AS v(id, clause, evidence, relevant)""",
    "fx_glossary": "SELECT abbr, expansion FROM (VALUES ('crar', 'capital to risk-weighted assets ratio'), ('lcr', 'liquidity coverage ratio'), ('nbfc', 'non-banking financial company'), ('lab', 'local area bank')) AS v(abbr, expansion)",
    "fx_asked": "SELECT id, text FROM (VALUES (1, 'What is the CRAR of an NBFC?'), (2, 'the crar and the lcr in a lab'), (3, 'LAB rules'), (4, 'small finance banks and LCR, LCR')) AS v(id, text)",
    "a_vectors": "SELECT e.vec_id, e.embedding, d.doc_id, d.text, CASE WHEN e.vec_id % 7 = 0 THEN 'stale' ELSE md5(d.text) END AS stored_hash FROM {embeddings} e LEFT JOIN {documents} d ON d.doc_id = e.vec_id",
    "a_files": """
SELECT doc_id, concat('file', CAST(doc_id AS STRING), CASE doc_id % 9 WHEN 0 THEN '.pdf' WHEN 1 THEN '.XLSX' WHEN 2 THEN '.csv' WHEN 3 THEN '.tsv' WHEN 4 THEN '.md' WHEN 5 THEN '.html' WHEN 6 THEN '.json' WHEN 7 THEN '.docx' ELSE '' END) AS file_name,
       doc_id % 18 = 0 AS scanned, text FROM {documents}""",
    "a_chunks": "SELECT doc_id AS chunk_id, source AS doc, lang AS category, text FROM {documents}",
    "a_questions": "SELECT item_id AS question_id, text FROM {benchmark}",
    "a_cases": """
SELECT d.doc_id AS case_id, d.lang AS rule_type, CASE l.quality WHEN 1 THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END AS gold,
       CASE WHEN d.n_chars % 17 = 0 THEN 'REQUIRES_HUMAN_REVIEW' WHEN d.n_chars % 5 = 0 THEN 'NON_COMPLIANT' ELSE 'COMPLIANT' END AS pred,
       CASE d.n_chars % 3 WHEN 0 THEN 'DETERMINISTIC' WHEN 1 THEN 'RAG_LLM' ELSE 'HUMAN' END AS route, d.n_chars AS cost, l.toxic AS toxic, d.source AS modality
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
}


class Tables:
    """Tables and views of a data folder as DataFrames: `Tables(spark, dir).a_rules`."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        if name not in self.made:
            self.made[name] = self.sql(VIEWS[name])
        return self.made[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in set(re.findall(r"\{(\w+)\}", text))})


def oracle(text: str) -> str:
    """SQL for the checking engine: the views that a statement uses come first, as common table expressions."""
    used: dict[str, str] = {}

    def need(sql: str) -> str:
        for name in re.findall(r"\{(\w+)\}", sql):
            if name in VIEWS and name not in used:
                used[name] = need(VIEWS[name])
        return re.sub(r"\{(\w+)\}", r"\1", sql)

    body = need(text)
    order = sorted(used, key=lambda n: _depth(n))
    return ("WITH " + ",\n".join(f"{n} AS ({used[n].strip()})" for n in order) + "\n" if used else "") + body.strip()


def _depth(name: str) -> int:
    return 1 + max((_depth(n) for n in re.findall(r"\{(\w+)\}", VIEWS[name]) if n in VIEWS), default=0)
