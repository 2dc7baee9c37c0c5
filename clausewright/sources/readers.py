"""Sources: text, delimited text, JSON figures; each a DataFrame in, a DataFrame out."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def text_pages(rows: DataFrame, key: str, text: str, lines_per_page: int = 80) -> DataFrame:
    """key, page, line_no, line: form feeds part pages; without any, every so many lines do."""
    pages = F.when(F.contains(c(text), F.lit("\f")), F.split(text, "\f")).otherwise(F.array(c(text)))
    fed = F.contains(c(text), F.lit("\f"))
    lines = rows.select(key, fed.alias("_fed"), F.posexplode(pages).alias("_page", "_body")).select(key, "_fed", "_page", F.posexplode(F.split("_body", "\n")).alias("_i", "line"))
    page = F.when(c("_fed"), c("_page")).otherwise(F.floor(c("_i") / lines_per_page)).cast("int") + 1
    return lines.select(key, page.alias("page"), (c("_i") + 1).alias("line_no"), "line")


def json_metrics(rows: DataFrame, key: str, body: str) -> DataFrame:
    """key, metric, value from JSON objects of numbers, bare or under "metrics"."""
    flat = F.coalesce(F.from_json(F.get_json_object(body, "$.metrics"), "map<string,double>"), F.from_json(body, "map<string,double>"))
    return rows.select(key, F.explode(flat).alias("metric", "value")).where("value IS NOT NULL")


def delimited_lines(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """file, line: the cells of CSV or TSV files joined by bars. Without a separator, the first line tells it."""
    head = spark.read.text(path).limit(1).collect()
    first = head[0][0] if head else ""
    sep = sep or max(("\t", ";", "|", ","), key=first.count)
    width = max(1, first.count(sep) + 1)
    table = spark.read.option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE").schema(", ".join(f"c{i} string" for i in range(width))).csv(path)
    return table.select(F.input_file_name().alias("file"), F.concat_ws(" | ", *[F.trim(f"c{i}") for i in range(width)]).alias("line"))


def binary_documents(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    """path, sha256, length, format of files under a folder, content left where it is until it is parsed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(path)
    magic = F.decode(F.substring("content", 1, 5), "ISO-8859-1")
    kind = F.when(magic.startswith("%PDF-"), "pdf").when(magic.startswith("PK"), "xlsx").otherwise(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length", kind.alias("format"))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with a header: quoted cells may hold line breaks, a byte-order mark is dropped, names are lower-cased."""
    table = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return table.toDF(*[n.lstrip("\ufeff").strip().strip('"').lower() for n in table.columns])


def json_fixture(spark: SparkSession, path: str, rows: str) -> DataFrame:
    """The rows of a JSON file that holds them as an array under a name."""
    return spark.read.option("multiLine", True).json(path).select(F.explode(rows).alias("row")).select("row.*")


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _sheets(content: bytes) -> Iterator[tuple[int, str, int, str]]:
    """page, sheet, line_no, line of a workbook: its sheets in order, the filled cells of a row joined by bars."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        tree = lambda name: ElementTree.fromstring(book.read(name))
        said = lambda node: "".join(t.text or "" for t in node.iter(f"{_SHEET}t"))
        shared = [said(x) for x in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in book.namelist() else []
        parts = {x.get("Id"): x.get("Target") for x in tree("xl/_rels/workbook.xml.rels")}
        for page, sheet in enumerate(tree("xl/workbook.xml").iter(f"{_SHEET}sheet"), 1):
            target = parts[sheet.get(_LINK)]
            rows = tree(target.lstrip("/") if target.startswith("/") else f"xl/{target}").iter(f"{_SHEET}row")
            for number, row in enumerate(rows, 1):
                cells = []
                for cell in row.iter(f"{_SHEET}c"):
                    value = cell.findtext(f"{_SHEET}v") or ""
                    kind = cell.get("t")
                    text = shared[int(value)] if kind == "s" and value else said(cell) if kind == "inlineStr" else {"0": "false", "1": "true"}.get(value, value) if kind == "b" else value
                    cells.append(re.sub(r"\s+", " ", text).strip())
                if any(cells):
                    yield page, sheet.get("name"), int(row.get("r") or number), " | ".join(x for x in cells if x)


def workbook_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, page, sheet, line_no, line, error of workbooks under a folder; one that can't be read is a row with the error. A
    workbook is one row of Spark's and is parsed where it is read."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file", "page", "sheet", "line_no", "line", "error"]
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    yield pd.DataFrame([(file, *row, None) for row in _sheets(content)], columns=names)
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError) as e:
                    yield pd.DataFrame([(file, None, None, None, None, f"unreadable workbook: {type(e).__name__}")], columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xls[xm]").load(path)
    return files.select("path", "content").mapInPandas(parse, "file string, page int, sheet string, line_no int, line string, error string")
