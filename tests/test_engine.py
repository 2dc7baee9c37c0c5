"""The engine: every query against its SQL, and the traps that small literal tables show."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright import plans
from clausewright.functions import numbers as N
from clausewright.functions import text as X
from clausewright.functions import wording as W
from clausewright.operators import evaluation as E
from clausewright.operators import graph as G
from clausewright.operators import routing as M
from clausewright.operators import rules as R
from clausewright.sources import readers, sinks
from clausewright.streaming import ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(x):
    return "[" + ",".join(map(plain, x)) + "]" if isinstance(x, (list, tuple)) else repr(x) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, duck, name):
    found = plans.QUERIES[name](spark, SF)
    wanted = duck.execute(plans.ORACLES[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    order = sorted(columns)
    theirs = sorted(tuple(plain(row[columns.index(k)]) for k in order) for row in wanted.fetchall())
    assert sorted(tuple(plain(row[k]) for k in order) for row in found.collect()) == theirs


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_other_queries_run(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_rounding_and_periods(spark):
    rows = spark.createDataFrame([(-2.5, "2024-03-31"), (2.5, "2024-04-01")], "x double, d string").withColumn("d", F.to_date("d"))
    got = rows.select(N.round_half_up(F.col("x"), 0), N.fiscal_label(N.fiscal_year(F.col("d")), N.fiscal_quarter(F.col("d"))), N.period_end(N.fiscal_year(F.col("d")), N.fiscal_quarter(F.col("d"))).cast("string")).collect()
    assert [tuple(r) for r in got] == [(-2.0, "Q4-FY2023-24", "2024-03-31"), (3.0, "Q1-FY2024-25", "2024-06-30")]


def test_unknown_operator_is_a_breach_and_conditions_are_not_checked(spark):
    rules = spark.createDataFrame([(1, "??", 5.0, "requirement"), (2, "<=", 5.0, "condition"), (3, "within_days", 5.0, "requirement"), (4, ">=", 5.0, "requirement")], "rule_id int, operator string, threshold double, atom_kind string")
    given = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 5.0)], "rule_id int, value double")
    assert {r.rule_id: r.status for r in R.check_rules(rules, given).collect()} == {1: "BREACH", 3: "PASS", 4: "NOT_REPORTED"}


def test_trend_anomaly(spark):
    values = [(1, i, v) for i, v in enumerate([10.0, 10.0, 10.0, 11.0])] + [(2, i, v) for i, v in enumerate([1.0, 2.0, 3.0, 50.0])] + [(3, 0, 9.0), (3, 1, 99.0)]
    found = R.trend_anomalies(spark.createDataFrame(values, "k int, i int, v double"), ["k"], [F.col("i")], "v").collect()
    flags = {(r.k, r.i): r.flag for r in found}
    assert flags[1, 3] == "first_change" and flags[2, 3] == "jump" and flags[3, 1] == "none" and flags[1, 2] == "none"


def test_trend_anomaly_at_just_three_deviations(spark, tmp_path):
    made = "SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, i // 3 AS user_id, 'r' AS event_type, (i // 3 // [400, 20, 1][1 + i % 3] % 20) / 10 AS value FROM range(24000) t(i)"
    duckdb.execute(f"COPY ({made}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    wanted = con.execute(f"SELECT event_id, n, flag FROM ({plans.ORACLES['a14_trend_anomaly']}) x").fetchall()
    found = plans.QUERIES["a14_trend_anomaly"](spark, str(tmp_path)).select("event_id", "n", "flag").collect()
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_version_in_force(spark):
    facts = spark.createDataFrame([("a", d) for d in ("2020-01-01", "2020-02-01", "2020-03-01")], "rule string, day string")
    versions = spark.createDataFrame([("a", "2020-02-01", 1.0), ("a", "2020-02-15", 2.0)], "rule string, since string, v double")
    got = R.version_in_force(facts, versions, "rule", "day", "since", "v").orderBy("day").collect()
    assert [r["v"] for r in got] == [None, 1.0, 2.0]


EDGES = "from_entity long, to_entity long, edge_type string, pct double, status string, bidirectional boolean"


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, k, float(p), s, w) for a, b, k, p, s, w in rows], EDGES)


def people(spark, n, sovereign=()):
    return spark.createDataFrame([(i, "sovereign" if i in sovereign else "company", False) for i in range(n)], "entity_id long, entity_type string, gold_loan boolean")


def test_control_is_more_than_half(spark):
    found = G.control_edges(edges(spark, (1, 2, "OWNS", 50, "confirmed", False), (1, 3, "OWNS", 51, "confirmed", False), (4, 5, "CONTROLS", 0, "confirmed", False), (6, 7, "OWNS", 90, "confirmed", False)), people(spark, 9, {6}))
    assert sorted(map(tuple, found.collect())) == [(1, 3), (4, 5)]


def test_connected_groups(spark):
    table = edges(
        spark,
        (1, 2, "OWNS", 60, "confirmed", False), (2, 3, "OWNS", 60, "confirmed", False),  # a chain
        (4, 5, "ECONOMIC_DEPENDENCE", 0, "confirmed", False), (5, 3, "ECONOMIC_DEPENDENCE", 0, "confirmed", False),  # contagion into it
        (6, 7, "CONTROLS", 0, "confirmed", False), (7, 6, "CONTROLS", 0, "confirmed", False),  # a cycle
        (7, 8, "COMMON_MANAGEMENT", 0, "confirmed", False), (1, 9, "CONTROLS", 0, "rebutted", False),
    )
    found = G.connected_groups(table, people(spark, 10)).collect()
    assert sorted(tuple(r.members) for r in found) == [(1, 2, 3, 4, 5), (6, 7, 8)]
    assert {r.group_id for r in found} == {"G1", "G2"}


def test_exposures_follow_their_protection(spark):
    rows = [(1, "equity", 100, None, 30, 2, False, None, False), (1, None, 50, None, 80, None, True, None, True), (2, "fund_based", 10, None, None, None, False, "guaranteed", False), (1, "fund_based", 40, None, 40, 3, False, None, False)]
    table = spark.createDataFrame(rows, "entity_id long, kind string, amount long, sanctioned long, crm long, crm_provider long, infrastructure boolean, exempt_reason string, board_approved boolean")
    found = {r.entity_id: r for r in G.aggregate_exposures(table, people(spark, 4, {3})).collect()}
    assert (found[1].total, found[1].equity, found[1].board_approved) == (70, 70, True)
    assert (found[2].total, found[2].exempt, found[2].crm_received) == (30, 10, 30)
    assert (found[3].total, found[3].exempt) == (0, 40)


def test_evaluation(spark):
    assert E.mcnemar(0, 0) == 1.0 and E.mcnemar(1, 8) == pytest.approx(2 * 9 / 256)
    points = spark.createDataFrame([(1, 0.9, 5.0), (2, 0.8, 5.0), (3, 0.9, 6.0), (4, 0.95, 7.0), (5, 0.9, 5.0)], "i int, good double, cost double")
    assert sorted(r.i for r in E.pareto_front(points, "good", "cost").collect()) == [1, 4, 5]
    low, high = E.cluster_bootstrap(spark.createDataFrame([(8.0, 10.0)] * 20, "v double, w double"), "v", "w", 200).first()
    assert low == high == pytest.approx(0.8)


def test_text(spark):
    row = spark.createDataFrame([("See No. 4. It is 2.5 per cent. Done.", "A (1) first (2) second", "(1,234.5)")], "a string, b string, c string")
    got = row.select(X.sentences(F.col("a")), X.sub_clauses(F.col("b")), X.number(F.col("c")), X.packed(F.array(*map(F.lit, ("aa", "bb", "cccccc"))), 5)).first()
    assert got[0] == ["See No. 4.", "It is 2.5 per cent.", "Done."] and got[1] == ["A", "(1) first", "(2) second"] and got[2] == -1234.5 and got[3] == ["aa bb", "cccccc"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('metric;value\n"cr;ar";9.5\n')
    assert [r.line for r in readers.delimited_lines(spark, str(tmp_path / "a.csv")).collect()] == ["metric | value", "cr;ar | 9.5"]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c", 1), (3, "d", 2)], "k int, v string, more int")
    assert sorted(tuple(r) for r in sinks.upsert(old, new, ["k"]).select("k", "v").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r.k for r in sinks.insert_or_ignore(old, new, ["k"]).collect()] == [3]
    sinks.publish(old, str(tmp_path / "t"))
    sinks.publish(new, str(tmp_path / "t"))
    assert sinks.read_published(spark, str(tmp_path / "t")).count() == 2
    for _ in range(2):
        sinks.append_run(old, str(tmp_path / "runs"), "r1")
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2


def test_streams(spark, tmp_path):
    inbox, schema = str(tmp_path / "in"), "key string, label string, seen_at int"
    where = [str(tmp_path / x) for x in ("state", "changes", "checkpoint")]
    for rows in ([("a", "1", 1), ("b", "1", 1)], [("a", "1", 2), ("b", "2", 2)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        ingest.detect_changes(ingest.arrivals(spark, inbox, schema), *where, "key", "label")
    assert sorted((r.key, r.label) for r in spark.read.parquet(where[1]).collect()) == [("a", "1"), ("b", "1"), ("b", "2")]
    for _ in range(2):
        ingest.ingest_once(ingest.arrivals(spark, inbox, schema), str(tmp_path / "out"), str(tmp_path / "c2"), "label")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_logistic_and_tree(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b), int(rng.random() < (0.9 if a > b else 0.2))) for a, b in rng.integers(0, 4, (300, 2)).tolist()]
    table = spark.createDataFrame(rows, "x1 double, x2 double, y int")
    x, y = np.array(rows)[:, :2], np.array(rows)[:, 2]
    w, b = np.zeros(2), np.log(y.mean() / (1 - y.mean()))
    for _ in range(3000):
        miss = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - 0.5 * (x.T @ miss / len(y) + 1e-3 * w), b - 0.5 * miss.mean()
    found = M.fit_logistic(table, ["x1", "x2"], "y")
    assert found[0] == pytest.approx(w.tolist(), abs=1e-6) and found[1] == pytest.approx(b, abs=1e-6)
    tree = M.fit_tree(table, ["x1", "x2"], "y")
    scored = table.select("x1", "x2", "y", M.tree_score(tree).alias("p")).collect()
    leaves = {}
    for r in scored:
        leaves.setdefault(r.p, []).append(r.y)
    assert all(p == pytest.approx((sum(ys) + 1) / (len(ys) + 2)) for p, ys in leaves.items()) and min(map(len, leaves.values())) >= 15
    assert np.mean([(r.p > 0.5) == r.y for r in scored]) > 0.75


def test_ultimate_controllers_match_brute_force(spark):
    tables = plans.views.Tables(spark, SF)
    control = {(r[0], r[1]) for r in G.control_edges(G.usable(tables.a_edges), tables.a_entities).collect()}
    reach = set(control)
    while True:
        more = {(a, d) for a, b in reach for c, d in control if b == c} - reach
        if not more:
            break
        reach |= more
    found = G.ultimate_controllers(spark.createDataFrame(sorted(control), "from_entity long, to_entity long"), spark.createDataFrame(sorted(reach), "from_entity long, to_entity long")).collect()
    held = {b for _, b in control}
    tops = {a for a, _ in control} - held
    by_root = {}
    for r in found:
        by_root.setdefault(r.root, set()).add(r.member)
    for top in tops:
        assert by_root[top] == {top} | {b for a, b in reach if a == top}
    assert set().union(*by_root.values()) == {x for e in control for x in e}


def test_group_checks(spark):
    table = edges(spark, (1, 2, "OWNS", 60, "confirmed", False), (3, 4, "OWNS", 70, "flagged", False), (5, 6, "CONTROLS", 0, "confirmed", False))
    entities = spark.createDataFrame([(i, "nbfc" if i == 6 else "company", False) for i in range(8)], "entity_id long, entity_type string, gold_loan boolean")
    amounts = spark.createDataFrame([(i, None, a, None, None, None, False, None, False) for i, a in ((1, 10), (2, 12), (3, 30), (4, 1), (5, 20), (6, 2))], "entity_id long, kind string, amount long, sanctioned long, crm long, crm_provider long, infrastructure boolean, exempt_reason string, board_approved boolean")
    found = {tuple(r.members): (r.status, r.limit_pct, r.total) for r in G.group_checks(table, entities, amounts, 100.0, 25.0, 20.0).collect()}
    assert found == {(1, 2): ("PASS", 25.0, 22), (3, 4): ("POTENTIAL_BREACH", 25.0, 31), (5, 6): ("BREACH", 20.0, 22)}


def test_bundles_and_exports(spark, tmp_path):
    entities = spark.createDataFrame([(1, "company"), (2, "bank")], "entity_id long, entity_type string")
    good, bad = (spark.createDataFrame([(1, b)], "from_entity long, to_entity long") for b in (2, 9))
    assert [r.message for r in sinks.import_bundle(entities, bad, ("company", "bank"), str(tmp_path / "net")).collect()] == ["edge to an entity that is not there"]
    assert not (tmp_path / "net").exists()
    assert sinks.import_bundle(entities, good, ("company", "bank"), str(tmp_path / "net")).count() == 0
    assert sinks.read_published(spark, str(tmp_path / "net/entities")).count() == 2
    rows = spark.createDataFrame([('a "b"\nc', 1)], "Name string, n int")
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert [tuple(r) for r in readers.csv_rows(spark, str(tmp_path / "csv")).collect()] == [('a "b"\nc', "1")] and readers.csv_rows(spark, str(tmp_path / "csv")).columns == ["name", "n"]
    (tmp_path / "f.json").write_text('{"version": 2, "questions": [{"id": 1, "q": "x"}, {"id": 2, "q": "y"}]}')
    assert sorted(tuple(r) for r in readers.json_fixture(spark, str(tmp_path / "f.json"), "questions").collect()) == [(1, "x"), (2, "y")]


def test_looks_and_documents_in(spark, tmp_path):
    inbox, state = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "key string, label string, seen_at int"
    spark.createDataFrame([("a", "1", 1)], schema).write.parquet(inbox)
    look = lambda n: ingest.check_only(ingest.arrivals(spark, inbox, schema), state, "key", "label", str(tmp_path / n))
    assert look("l1") == [("a", "1")] and look("l2") == [("a", "1")]
    ingest.detect_changes(ingest.arrivals(spark, inbox, schema), state, str(tmp_path / "changes"), str(tmp_path / "c"), "key", "label")
    assert look("l3") == []
    spark.createDataFrame([("d", "See paragraph 4(2).\n\nAnd Annex II.")], "doc string, body string").write.parquet(str(tmp_path / "docs"))
    ingest.ingest_documents(ingest.arrivals(spark, str(tmp_path / "docs"), "doc string, body string"), str(tmp_path / "out"), str(tmp_path / "c3"), "doc", "body")
    assert sorted((r.kind, r.target) for r in spark.read.parquet(str(tmp_path / "out/references")).collect()) == [("annex", "II"), ("paragraph", "4(2)")]


def test_clause_roles(spark):
    rows = [("[Omitted]", None), ("'Bank' means x; 'Fund' includes y.", None), ("Text.", "Definitions"), ("These shall be called the Rules.", None), ("They stand repealed.", None), ("It is mandatory.", None), ("Note.", None)]
    got = spark.createDataFrame(rows, "t string, h string").select(X.clause_role(F.col("t"), F.col("h"))).collect()
    assert [r[0] for r in got] == ["deleted", "definition", "definition", "short_title", "repeal", "obligation", "information"]


def test_indian_number_groups_crores(spark):
    got = spark.createDataFrame([(1069065000.0,), (-7126292100.5,), (10000000.0,)], "x double").select(W.indian_number(F.col("x"))).collect()
    assert [r[0] for r in got] == ["1,06,90,65,000", "-7,12,62,92,100.5", "1,00,00,000"]
