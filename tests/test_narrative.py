"""Stems, stemmed ranking, reports as HTML, and odd rows in the narrative operators."""

import math
import re
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clausewright.functions import naming as N
from clausewright.functions import plainer as P
from clausewright.operators import answering as A
from clausewright.operators import passages as X
from clausewright.operators import segments as S
from clausewright.sources import readers, sinks

STEMS = "caresses caress, ponies poni, cats cat, feed feed, agreed agre, plastered plaster, motoring motor, sing sing, conflated conflat, troubled troubl, sized size, hopping hop, falling fall, hissing hiss, failing fail, filing file, happy happi, sky sky, relational relat, conditional condit, rational ration, digitizer digit, operator oper, feudalism feudal, decisiveness decis, hopefulness hope, triplicate triplic, formative form, electrical electr, goodness good, revival reviv, allowance allow, inference infer, adjustment adjust, adoption adopt, probate probat, rate rate, cease ceas, controlling control, rolling roll, is is, 9th 9th, ties ti"


def test_stems():
    for pair in STEMS.split(", "):
        word, wanted = pair.split()
        assert A.stem(word) == wanted, word


def test_stemmed_ranking_matches_brute_force(spark):
    chunks = [(1, "Banks lending to banks"), (2, "A bank lends"), (3, "weather reports"), (4, None), (5, "the policy and the policies")]
    asked = [(1, "lend bank"), (2, "policy reported"), (3, None)]
    words = lambda x: [A.stem(w) for w in re.split(r"[\W_]+", (x or "").lower()) if w]
    docs = {k: words(x) for k, x in chunks}
    n, mean = len(docs), sum(map(len, docs.values())) / sum(1 for _, x in chunks if x is not None)
    wanted = {}
    for q, text in asked:
        for w in set(words(text)):
            df = sum(w in d for d in docs.values())
            for k, d in docs.items():
                if w in d:
                    tf = Counter(d)[w]
                    idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
                    wanted[q, k] = wanted.get((q, k), 0) - idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
    found = A.stemmed_bm25(spark.createDataFrame(chunks, "chunk_id int, text string"), spark.createDataFrame(asked, "question_id int, text string")).collect()
    assert {(r.question_id, r.chunk_id): r.score for r in found} == pytest.approx(wanted)


def test_html_report(spark, tmp_path):
    rows = spark.createDataFrame([(2, "a<b & c"), (1, None)], "n int, Name string")
    sinks.write_html(rows, str(tmp_path / "r"), "Front & rear", ["n"])
    page = "\n".join(r.value for r in spark.read.text(str(tmp_path / "r")).collect())
    assert "<title>Front &amp; rear</title>" in page and page.index("<td>1</td><td></td>") < page.index("<td>2</td><td>a&lt;b &amp; c</td>")


def test_nothing_and_nulls(spark):
    empty = spark.createDataFrame([(None, "x" * 50_000), (1, None)], "id int, text string")
    got = empty.select(N.title_category(F.col("text")), N.topic(F.col("text")), P.simplified(F.col("text"))).collect()
    assert [r[0] for r in got] == [None, None] and got[1][1] == "" and len(got[0][2]) == 1 and got[1][2] is None
    pages = spark.createDataFrame([], "document string, page int, lines array<string>")
    assert X.profiles(pages).count() == 0 and X.governance_passages(pages).count() == 0
    lines = spark.createDataFrame([("d", 1, 1, None, None, None, None), ("d", 1, 2, "1. One", 72.0, 11.0, False)], "document string, page int, line int, text string, x0 double, size double, bold boolean")
    assert [r.kind for r in S.segments(lines).orderBy("place").collect()] == ["preamble", "paragraph"] and S.segments(lines.limit(0)).count() == 0


def test_days(spark):
    rows = spark.createDataFrame([("31st March, 2025",), ("Mar 31, 2025",), ("31/03/2025",), ("31 Foo 2025",), ("99.99.2025",), (None,)], "x string")
    assert [str(r[0]) for r in rows.select(N.written_day(F.col("x"))).collect()] == ["2025-03-31"] * 3 + ["None"] * 3


def test_workbooks(spark, tmp_path):
    space, link = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = lambda rows: f'<worksheet xmlns="{space}"><sheetData>{rows}</sheetData></worksheet>'
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{space}" xmlns:r="{link}"><sheets><sheet name="Ratios" r:id="a"/><sheet name="Notes" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="a" Target="worksheets/s2.xml"/><Relationship Id="b" Target="/xl/worksheets/s1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{space}"><si><t>CRAR</t></si><si><r><t>two </t></r><r><t> runs</t></r></si></sst>',
        "xl/worksheets/s2.xml": sheet('<row r="1"><c t="s"><v>0</v></c><c/><c><v>14.25</v></c></row><row r="2"><c/></row><row r="5"><c t="b"><v>1</v></c></row>'),
        "xl/worksheets/s1.xml": sheet('<row><c t="s"><v>1</v></c><c t="inlineStr"><is><t>in line</t></is></c></row>'),
    }
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)
    (tmp_path / "b.xlsx").write_bytes(b"PK no workbook")
    got = readers.workbook_lines(spark, str(tmp_path)).collect()
    assert sorted((r.page, r.sheet, r.line_no, r.line) for r in got if r.error is None) == [(1, "Ratios", 1, "CRAR | 14.25"), (1, "Ratios", 5, "true"), (2, "Notes", 1, "two runs | in line")]
    assert [r.error for r in got if r.error] == ["unreadable workbook: BadZipFile"]
