"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat, keep_rows, materialize, pick, runs

WINDOW = 10
#: Windows in one block of patterns. A block is what a worker holds at once; a benchmark of any size is
#: searched block after block.
BLOCK_WINDOWS = 100_000
#: ASCII: capital letters to small ones, digits and small letters as they are, all else separates.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, hit_starts array<int>, hit_ends array<int>"
_HITS = "doc_id long, mark long, block int, starts array<int>, ends array<int>, items array<string>"


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORDS).split() if text else []


class Matcher:
    """Wu-Manber tables for word sequences that all have `m` words.

    A block is the last two words looked at (one, where m is 1). shift: how far a block lets the search
    move on; blocks that no pattern holds move it by m - 1 words. tails: for the blocks in which patterns
    end, the patterns themselves, found by their hash and then compared word for word.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], dict[str | None, None]], m: int):
        self.m, self.b = m, min(2, m)
        self.most = m - self.b + 1
        self.shift: dict = {}
        self.tails: dict = {}
        for p, items in patterns.items():
            for end in range(self.b - 1, m):
                block = p[end - 1 : end + 1] if self.b == 2 else p[end]
                self.shift[block] = min(self.shift.get(block, self.most), m - 1 - end)
            self.tails.setdefault(p[-2:] if self.b == 2 else p[-1], {})[p] = items

    def find(self, text: list[bytes]) -> Iterator[tuple[int, int, dict[str | None, None]]]:
        m, most, n, shift, at = self.m, self.most, len(text), self.shift.get, self.m - 1
        if self.b == 1:
            for i, w in enumerate(text):
                if w in self.tails:
                    yield i, i + 1, self.tails[w][(w,)]
            return
        while at < n:
            block = (text[at - 1], text[at])
            move = shift(block, most)
            if move:
                at += move
                continue
            items = self.tails[block].get(tuple(text[at - m + 1 : at + 1]))
            if items is not None:
                yield at - m + 1, at + 1, items
            at += 1


def _windows(rows: Iterator, window: int) -> Iterator[tuple[tuple[bytes, ...], str | None]]:
    for item, text in rows:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            yield tuple(w[i : i + window]), None if item is None else str(item)


def _blocks(benchmark: DataFrame, window: int, limit: int) -> Iterator[list[Matcher]]:
    """Matchers for blocks of the benchmark's windows, made from one block of rows at a time."""
    held: dict[int, dict[tuple[bytes, ...], dict[str | None, None]]] = {}
    n = 0
    for pattern, item in _windows(benchmark.toLocalIterator(), window):
        items = held.setdefault(len(pattern), {}).setdefault(pattern, {})
        n += not items
        items[item] = None
        if n >= limit:
            yield [Matcher(p, m) for m, p in held.items()]
            held, n = {}, 0
    if held:
        yield [Matcher(p, m) for m, p in held.items()]


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the spans' union."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return [x[0] for x in merged], [x[1] for x in merged]


def _occurrences(matchers: list[Matcher], text: list[bytes]) -> tuple[list[tuple[int, int]], list[str | None]]:
    """Spans of the patterns in a text, and the ids of their items: strings in order, then null."""
    spans, found = [], set()
    for m in matchers:
        for a, b, ids in m.find(text):
            spans.append((a, b))
            found.update(ids)
    return spans, _ordered(found)


def _ordered(ids: Iterable[str | None]) -> list[str | None]:
    return sorted(ids, key=lambda x: (x is None, x or ""))


def _result(doc: list, n_words: list, found: list[tuple[list[int], list[int], list[str | None]]]) -> pa.RecordBatch:
    rows = []
    for d, n, (starts, ends, ids) in zip(doc, n_words, found, strict=True):
        hit = sum(ends) - sum(starts)
        rows.append((d, n, hit, len(ids), hashlib.sha256(",".join(x or "" for x in ids).encode()).hexdigest(), hit > 0, ids, starts, ends))
    ints = pa.list_(pa.int32())
    kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_(), pa.list_(pa.string()), ints, ints]
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in SCHEMA.split(", ")])


def _hits(rows: DataFrame, blocks: Iterator[list[Matcher]]) -> DataFrame:
    """doc_id, mark, block, starts, ends, items of the texts in which a block's patterns occur: a pass over the texts for
    each block, of which only these few come out. Rows that repeat doc_id and text are one."""
    spark, found = rows.sparkSession, None
    for number, block in enumerate(blocks):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            for batch in runs(batches):
                out = []
                for doc, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "text")), strict=True):
                    spans, ids = _occurrences(shared.value, words(text))
                    if spans:
                        out.append((doc, mark, number, *_merged(spans), ids))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
                yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [c.split()[0] for c in _HITS.split(", ")])

        part = materialize(rows.mapInArrow(search, _HITS), "decontaminate")
        shared.unpersist()
        found = part if found is None else found.union(part)
    return found.dropDuplicates(["doc_id", "mark", "block"])


def find_contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Which words of each document lie in an occurrence of a window of a benchmark item.

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one
    window. Result, a row per document: doc_id, n_words, n_hit (words hit), n_items, items_sha256,
    contaminated, items (ids as strings, sorted), hit_starts and hit_ends (word spans, disjoint).
    The documents are searched where they lie: nothing is shuffled. The patterns reach the workers in
    blocks of `block_windows`; with more than one, each costs a pass over the documents, out of which only the spans of
    those with occurrences come, and doc_id, a hash of the text and the number of words are joined to them.

    Null and empty texts have no words and are never contaminated, nor does such an item match. Items
    that share a window are all named; a null item_id is an item of its own, last and empty among the ids. Repeated
    documents get a row each. A very long text is one list of words at a time. An empty benchmark leaves all documents clean. Other columns are ignored.
    """
    rows = pick(docs, doc_id="doc_id", text="text")
    blocks = _blocks(pick(benchmark, item_id="item_id", text="text"), window, block_windows)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        shared = spark.sparkContext.broadcast(first)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in runs(batches):
                said = [words(t) for t in batch.column("text").to_pylist()]
                found = [_occurrences(shared.value, w) for w in said]
                yield _result(batch.column("doc_id").to_pylist(), list(map(len, said)), [(*_merged(spans), ids) for spans, ids in found])

        return rows.mapInArrow(search, SCHEMA)

    marked = rows.withColumn("mark", F.xxhash64("text"))
    hits = _hits(marked, chain((first, second), blocks))
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")]
    hits = hits.groupBy(F.col("doc_id").alias("id"), F.col("mark").alias("text_mark")).agg(*lists)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            n = [len(words(t)) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64())], ["doc_id", "mark", "n_words"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, n, *lists = (batch.column(c).to_pylist() for c in ("doc_id", "n_words", "starts", "ends", "items"))
            found = [(*_merged(list(zip(a or [], b or [], strict=True))), _ordered(set(c or []))) for a, b, c in zip(*lists, strict=True)]
            yield _result(doc, n, found)

    counted = marked.mapInArrow(count, "doc_id long, mark long, n_words long")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("text_mark"))
    return counted.join(hits, same, "left").select("doc_id", "n_words", "starts", "ends", "items").mapInArrow(join, SCHEMA)


def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents that no benchmark window occurs in, with all their columns. One block of patterns is decided on where
    the rows lie; of more, the few documents with occurrences are found first, a pass for each block.

    Null and empty texts stay, rows that repeat stay or go together, an empty table or benchmark changes nothing. A very
    long text is one list of words at a time.
    """
    blocks = _blocks(pick(benchmark, item_id="item_id", text="text"), window, block_windows)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        shared = spark.sparkContext.broadcast(first)
        return keep_rows(docs, "text", lambda texts: [not any(next(m.find(w), None) for m in shared.value) for w in map(words, texts)])
    rows, at = flat(docs)
    marked = pick(docs, doc_id="doc_id", text="text").withColumn("mark", F.xxhash64("text"))
    hits = _hits(marked, chain((first, second), blocks)).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    same = F.col(at["doc_id"]).eqNullSafe(F.col("__id")) & (F.xxhash64(at["text"]) == F.col("__mark"))
    return rows.join(hits, same, "left_anti").toDF(*docs.columns)
