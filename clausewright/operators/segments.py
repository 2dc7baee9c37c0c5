"""Documents cut into preamble, chapters, sections, numbered paragraphs and annexes, and titles from their bold lines."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

c = F.col
#: What opens a block; a number before a unit is text.
_CHAPTER = re.compile(r"(?i)^chapter\s*[-–]?\s*(?:[ivxlc]+|\d+)\b")
_SECTION = re.compile(r"^(?:[A-Z]|[IVX]{1,5})\.\s+[A-Z]\S*")
_ANNEX = re.compile(r"(?i)^(?:annex(?:ure)?|appendix|schedule)\b[\s–-]*(?:[ivxlc]+|\d+|[a-z])?\s*(?:[:.–-].*)?$")
_DECIMAL = re.compile(r"^(\d{1,2}(?:\.\d{1,2}){1,3})\.?\s+(?!\d)(\S.*)$")
_FLAT = re.compile(r"^(\d{1,3})([A-Z]?)\s*[.)](?!\d)\s*(.*)$")
_UNIT = re.compile(r"(?i)^(?:per\s*cent|%|crore|lakh|days?|months?|years?)\b")
#: Furthest jump of a numbering, and lines in which a skipped number may still come.
JUMP, AHEAD = 6, 12


def _blocks(rows: list[tuple]) -> Iterator[dict]:
    """The blocks of one document's lines (page, text, x0, size, bold), in order; every line is in one of them."""
    body = Counter(r[3] for r in rows).most_common(1)[0][0]
    margin = min(r[2] for r in rows if r[3] >= body - 1.1)
    numbers = [int(m[1]) if (m := _FLAT.match(r[1])) and not _UNIT.match(m[3]) else None for r in rows]
    block = {"kind": "preamble", "key": "", "page": rows[0][0], "lines": []}
    heading, scope, flat, decimal, style, annex, fresh = "", 0, 0, (), None, False, False

    def opened(i: int) -> tuple[str, str] | None:
        """The kind and key of the block that line i opens."""
        nonlocal scope, flat, decimal, style, fresh
        _, text, x0, size, bold = rows[i]
        if _CHAPTER.match(text):
            return "chapter", text
        if _ANNEX.match(text) and len(text) < 80:
            return "annex", text
        if bold and _SECTION.match(text) and len(text) < 120:
            return "section", text
        if annex or " | " in text or x0 > margin + 22 or size < body - 1.1:
            return None
        if (m := _DECIMAL.match(text)) and style != "flat" and not _UNIT.match(m[2]):
            number = tuple(map(int, m[1].split(".")))
            if (number[0] <= 3 if not decimal else number > decimal and number[0] <= decimal[0] + 2):
                style, decimal = "decimal", number
                return "paragraph", m[1]
            return None
        n = numbers[i]
        if n is None:
            return None
        if style == "decimal":
            if n != decimal[0] + 1:
                return None
            decimal = (n,)
            return "paragraph", str(n)
        suffix = _FLAT.match(text)[2]
        comes = any(x == flat + 1 for x in numbers[i + 1 : i + 1 + AHEAD])
        if flat and n == 1 and fresh:
            scope += 1
        elif not (n == 1 if not flat else (suffix and n == flat) or n == flat + 1 or (flat + 1 < n <= flat + JUMP and not comes)):
            return None
        style, flat = "flat", n
        return "paragraph", f"{scope}.{n}{suffix}" if scope else f"{n}{suffix}"

    for i, row in enumerate(rows):
        found = opened(i)
        if found:
            if block["lines"]:
                yield block | {"heading": heading}
            kind, key = found
            annex = kind == "annex" or (annex and kind not in ("chapter",))
            fresh = kind in ("chapter", "section", "annex") or (fresh and kind != "paragraph")
            heading = key if kind in ("chapter", "section", "annex") else heading
            block = {"kind": kind, "key": key, "page": row[0], "lines": []}
        block["lines"].append(row[1])
        block["page_end"] = row[0]
    yield block | {"heading": heading}


def segments(lines: DataFrame) -> DataFrame:
    """document, place, kind, key, heading, page, page_end, text: the blocks of documents, no text left out.

    lines: document, page, line, text, x0, size, bold. A paragraph opens with the next number of its document's scheme, flat or
    decimal, at the left margin in body size; a jump of up to JUMP counts where the number in between does not follow soon; a
    numbering that begins anew under a heading is a new scope. What a number means depends on all before it, so a document's lines
    are one group.
    """

    def cut(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["page", "line"])
        usual = lambda name, pick: part[name].astype(float).fillna(pick(part[name].dropna().astype(float)) if part[name].notna().any() else 0.0)
        size, x0 = usual("size", lambda known: known.mode().iat[0]), usual("x0", min)
        rows = list(zip(part["page"], part["text"].fillna("").str.strip(), x0, size, part["bold"].eq(True), strict=True))
        out = [(part["document"].iat[0], i, b["kind"], b["key"], b["heading"], b["page"], b["page_end"], "\n".join(b["lines"])) for i, b in enumerate(_blocks(rows))]
        return pd.DataFrame(out, columns=["document", "place", "kind", "key", "heading", "page", "page_end", "text"])

    kind = lines.schema["document"].dataType.simpleString()
    return lines.groupBy("document").applyInPandas(cut, f"document {kind}, place int, kind string, key string, heading string, page int, page_end int, text string")


def bold_titles(lines: DataFrame) -> DataFrame:
    """document, title: the first run of bold lines on the first two pages (60 lines at most) that reads like a title.

    lines: document, page, line, text, bold. Banners in capitals, references, dates, headings and tables of contents are no part of
    one; a run ends where the title is complete.
    """
    text = F.trim(F.regexp_replace("text", r"(?i)\(\s*Updated\s+as\s+on\s+[^)]+\)", ""))
    head = lines.where("page <= 2").withColumn("text", text).where("text <> ''")
    order = Window.partitionBy("document").orderBy("page", "line")
    first = head.withColumn("_i", F.row_number().over(order)).where("_i <= 60")
    capitals = (c("text") == F.upper("text")) & (F.length("text") < 60) & ~F.upper("text").contains("DIRECTION")
    other = c("text").rlike(r"RBI/(?:[\w\-]+/)?\d{4}-\d{2}/\d+|\b[A-Za-z]{2,6}\.\s?[A-Z]{2,}.*?/\d{4}-\d{2}\b|(?i)^\s*(?:table\s+of\s+contents|contents|index)\s*$|(?:\.\s?){5,}|…{2,}|_{5,}|^(?:dated\s+)?[A-Z][a-z]+ \d{1,2}, ?\d{4}$|^chapter\s|^[A-Z]\.\s+[A-Z]")
    inside = c("bold") & ~capitals & ~other
    done = c("text").rlike(r"(?:Directions?|Guidelines|Circular),?\s*(?:\d{4})?\s*(?:–\s*\w+)?\s*$")
    before = F.coalesce(F.lag(inside).over(order), F.lit(False)) & ~F.coalesce(F.lag(done).over(order), F.lit(False))
    runs = first.withColumn("_in", inside).withColumn("_run", F.sum(F.when(inside & before, 0).otherwise(1)).over(order)).where("_in")
    joined = runs.groupBy("document", "_run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "text"))), lambda x: x["text"]), " ").alias("_title"))
    titles = joined.where(c("_title").rlike(r"(?i)\b(?:directions?|guidelines|circular|regulations?|framework|norms)\b") & (F.length("_title") > 15))
    tidy = F.regexp_replace(F.regexp_replace("_title", r"^\s*Master\s+Directions?\s*[-–—]?\s*(?=Reserve Bank of India\s*\()", ""), r"\s+", " ")
    return titles.groupBy("document").agg(F.min_by(F.trim(tidy, F.lit(" -–—,")), "_run").alias("title"))
