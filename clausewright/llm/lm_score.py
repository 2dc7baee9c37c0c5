"""Stupid-backoff scores of documents: n-gram count tables by hash bucket, joined to the documents' n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pick, runs, trim

#: The factor of a step back to the shorter context.
BACKOFF = 0.4
ORDER = 3
#: Text of one block of documents. A block's n-grams travel together, each different one once.
BLOCK_BYTES = 4 << 20
#: Different n-grams that one bucket of the count tables gets from all blocks, at most and about.
BUCKET_GRAMS = 1 << 20
LEAST_BUCKET_BITS = 10
#: Rows of n-grams that a task's Python gets at once: Spark's 10,000 are some 45 MB in the JVM and in Python.
WIDE = 1024

# Words are hashed by a polynomial over random numbers for their bytes, modulo 2^64, so that the hashes of all words of
# a text come from one running sum. A-Z have the numbers of a-z.
_BYTES = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_IN_WORD = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93
_CHUNK = 1 << 19

_BLOCKS = "block long, n int, bucket int, n_words long, doc_ids array<long>, ends array<long>, data binary"
_REQUESTS = "bucket int, block long, grams binary, times binary"
_ANSWERS = "block long, n int, bucket int, data binary"
_RESULT = "doc_id long, n_words long, score double, per_word double"


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2^64."""

    def of(x: int) -> np.ndarray:
        found = np.full(n, x, np.uint64)
        found[0] = 1
        return np.cumprod(found)

    return of(_BASE), of(pow(_BASE, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    """h, with all bits of each number spread over the whole of it, in place."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h ^= h >> np.uint64(33)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(33)
    return h


def _starts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end."""
    edge = np.diff(_IN_WORD[np.frombuffer(data, np.uint8)].astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and its 64-bit hash."""
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(data):
        cut = _BLANK.search(data, at + _CHUNK)
        to = cut.end() if cut else len(data)
        part = data[at:to]
        power, inverse = _powers(1 << (len(part) - 1).bit_length())
        first, last = _starts(part)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[np.frombuffer(part, np.uint8)] * power[: len(part)], out=total[1:])
        starts.append(first + at)
        hashes.append(_mixed((total[last] - total[first]) * inverse[first]))
        at = to
    return np.concatenate(starts), np.concatenate(hashes)


def _sorted_places(key: np.ndarray) -> np.ndarray:
    """A stable argsort. Leading bits and place are sorted as one number, which is much faster than places by key;
    the few keys that differ in their last bits only are put right afterwards."""
    bits = max(1, (len(key) - 1).bit_length())
    low = np.uint64((1 << bits) - 1)
    both = key & ~low
    both |= np.arange(len(key), dtype=np.uint64)
    both.sort()
    order = (both & low).astype(np.int64)
    both >>= np.uint64(bits)
    ordered = key[order]
    same = both[1:] == both[:-1]
    for i in np.flatnonzero(same & (ordered[1:] != ordered[:-1])).tolist():
        lo, hi = np.searchsorted(both, both[i], "left"), np.searchsorted(both, both[i], "right")
        part = np.sort(order[lo:hi])
        order[lo:hi] = part[np.argsort(key[part], kind="stable")]
    return order


def _edges(ordered: np.ndarray) -> np.ndarray:
    """Where each different value of an ordered array begins."""
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return np.flatnonzero(new)


class _Grams:
    """The n-grams of a block of documents, of some orders, by the order.

    doc: the document of each word. at: the place of each n-gram's last word; key: its hash.
    """

    def __init__(self, ends: pa.ListScalar, data: pa.BinaryScalar, least: int = 1, order: int = ORDER):
        ends = ends.values.to_numpy()
        start, key = word_hashes(pa.decompress(data.as_buffer(), int(ends[-1]) - 1, "zstd", asbytes=True))
        self.words = np.diff(np.searchsorted(start, ends), prepend=0)
        self.doc = np.repeat(np.arange(len(ends)), self.words)
        self.at, self.key = {}, {}
        if least == 1:
            self.at[1], self.key[1] = np.arange(len(key)), key
        word = key
        for n in range(2, order + 1):
            key = key[:-1] * np.uint64(_STEP + 2 * n) + word[n - 1 :]
            if n >= least:
                whole = self.doc[n - 1 :] == self.doc[: max(0, len(self.doc) - n + 1)]
                self.at[n], self.key[n] = np.flatnonzero(whole) + n - 1, key[whole]

    def distinct(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The different keys of an order, sorted, and their counts."""
        ordered = np.sort(self.key[n])
        first = _edges(ordered)
        return ordered[first], np.diff(np.append(first, len(ordered)))

    def elsewhere(self, n: int, others: np.ndarray) -> np.ndarray:
        """For each place, how often the n-gram that ends there occurs in other documents than its own; 0 where none
        ends. others: how often each different n-gram occurs outside of this block. The order's n-grams are given up."""
        key, at = self.key.pop(n), self.at.pop(n)
        order = _sorted_places(key)
        ordered, at = key[order], at[order]
        del key, order
        doc = self.doc[at]
        new = np.ones(len(doc), bool)
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        both = new.copy()
        both[1:] |= doc[1:] != doc[:-1]
        first, begin = np.flatnonzero(new), np.flatnonzero(both)
        times = np.diff(np.append(begin, len(doc)))
        whole = (others + np.diff(np.append(first, len(doc))))[np.cumsum(new[begin]) - 1]  # a count for each (key, document)
        found = np.zeros(len(self.doc), np.int64)
        found[at] = np.repeat(whole - times, times)
        return found


def _packed(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest one asks; the first byte says how many."""
    top = int(x.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks of documents: their ids, where each one's text ends in the block, and the texts, parted by newlines and
    compressed."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in runs(batches, limit=block_bytes):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            ends = np.cumsum([len(t) + 1 for t in texts])
            data = b"\n".join(texts)
            lists = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), x) for x in (batch.column("doc_id"), pa.array(ends, pa.int64()))]
            yield pa.record_batch([pa.array([block]), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([len(_starts(data)[0])]), *lists, pa.array([pa.compress(data, "zstd", asbytes=True)], pa.binary())], [c.split()[0] for c in _BLOCKS.split(", ")])
            block += 1

    return pick(docs, doc_id="doc_id", text="text").mapInArrow(build, _BLOCKS)


def _request(n: int, bits: int):
    """A mapInArrow function: a block's different n-grams with their counts, a row for each bucket of hashes."""

    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for batch in batches:
            for block, ends, data in zip(*(batch.column(c) for c in ("block", "ends", "data")), strict=True):
                key, times = _Grams(ends, data, n, n).distinct(n)
                bucket = (key >> np.uint64(64 - bits)).astype(np.int32)
                edge = _edges(bucket)
                # Bytes of like weight of the steps from key to key lie side by side: they are small on disk.
                step = np.diff(key, prepend=np.uint64(0))
                step[edge] = key[edge]
                spans = list(zip(edge.tolist(), [*edge[1:].tolist(), len(bucket)][: len(edge)], strict=True))
                grams = [step[a:b].view(np.uint8).reshape(-1, 8).T.tobytes() for a, b in spans]
                yield pa.record_batch(
                    [pa.array(bucket[edge]), pa.array([block.as_py()] * len(edge), pa.int64()), pa.array(grams, pa.binary()), pa.array([_packed(times[a:b]) for a, b in spans], pa.binary())],
                    [c.split()[0] for c in _REQUESTS.split(", ")],
                )

    return request


def _keys(grams: pa.BinaryScalar) -> np.ndarray:
    planes = np.frombuffer(grams.as_buffer(), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _groups(batches: Iterator[pa.RecordBatch], key: str, names: tuple[str, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows (names) by key, of batches that are sorted by it; one key's rows are held at a time."""
    trim()
    now, held = None, []
    for batch in batches:
        for k, *row in zip(batch.column(key).to_pylist(), *(batch.column(n) for n in names), strict=True):
            if k != now and held:
                yield now, held
                held = []
            now = k
            held.append(tuple(row))
    if held:
        yield now, held


def _answer(n: int):
    """A mapInArrow function: the count table of each bucket, joined to what the blocks asked: how often their n-grams
    occur outside of them."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches, "bucket", ("block", "grams", "times")):
            keys, own = [_keys(g) for _, g, _ in rows], [_unpacked(t.as_py()) for _, _, t in rows]
            key, times = np.concatenate(keys), np.concatenate(own)
            order = _sorted_places(key)
            first = _edges(key[order])
            total = np.add.reduceat(times[order], first)
            others = np.empty(len(key), np.int64)
            others[order] = np.repeat(total, np.diff(np.append(first, len(key)))) - times[order]
            parts = np.split(others, np.cumsum([len(k) for k in keys])[:-1])
            same = lambda x: pa.array([x] * len(rows), pa.int32())
            yield pa.record_batch([pa.array([b.as_py() for b, _, _ in rows], pa.int64()), same(n), same(bucket), pa.array([_packed(x) for x in parts], pa.binary())], [c.split()[0] for c in _ANSWERS.split(", ")])

    return answer


def _scores(grams: _Grams, others: dict[int, np.ndarray], total: int, backoff: float) -> np.ndarray:
    """The score of each document of a block."""
    words, back = grams.words, np.log(backoff)
    nth = np.arange(len(grams.doc)) - np.repeat(np.cumsum(words) - words, words)
    count = grams.elsewhere(1, others[1])
    s = np.log(np.maximum(count, 0.5)) - np.repeat(np.log(np.maximum(total - words, 1)), words) + back * np.minimum(nth, ORDER - 1)
    for n in range(2, ORDER + 1):
        shorter, count = count, grams.elsewhere(n, others[n])
        at = np.flatnonzero(count > 0)
        s[at] = np.log(count[at]) - np.log(np.maximum(shorter[at - 1], 1)) + back * (np.minimum(nth[at], ORDER - 1) - n + 1)
    return np.bincount(grams.doc, weights=s, minlength=len(words)).astype(np.float64)


def score_documents(spark: SparkSession, docs: DataFrame, backoff: float = BACKOFF, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Stupid-backoff log score of every document: doc_id, n_words, score (sum of logs), per_word.

    Words are blank-separated, A-Z lower-cased. A document is scored by the counts of all other documents: c is
    how often an n-gram occurs in the whole table less its occurrences in the document itself. A word w after
    u, v scores log(c(u v w) / c(u v)) if c(u v w) > 0; else log(backoff * c(v w) / c(v)) if c(v w) > 0; else
    log(backoff^2 * max(c(w), 1/2) / N), N being the words of the other documents (1 at least). A document's
    first word has no context and steps back from none, its second one from one.

    Every word, pair and triple of every document is counted, whatever its count and at every size. Documents
    lie in blocks; the different n-grams of each block, with their counts, are dealt out by hash into the buckets
    of the count table, so a frequent n-gram is one entry of each block and no hot key; buckets are summed, and
    what the other blocks hold is joined back to the block, where it is summed by document. Buckets grow in
    number with the corpus, so that one always fits a task. N-grams are known by a 64-bit hash: two that share one
    count as one, which some 10^-7 of them do among 10^13.

    A very long text is a block of its own. Null, empty and blank texts have no words, score 0 and per_word
    null. Repeated rows are each counted and each scored, and count as other documents for each other. An empty
    table gives an empty result. Other columns are ignored.
    """
    blocks = materialize(_blocks(docs, block_bytes), "lm_blocks")
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    bits = max(LEAST_BUCKET_BITS, (total // BUCKET_GRAMS).bit_length())
    rows = blocks.drop("n_words")
    for n in range(1, ORDER + 1):  # one after the other, so that only one order's n-grams are on disk at a time
        asked = blocks.select("block", "ends", "data").mapInArrow(_request(n, bits), _REQUESTS)
        counted = asked.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(_answer(n), _ANSWERS)
        rows = rows.unionByName(materialize(counted, "lm_counts", WIDE), allowMissingColumns=True)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _groups(batches, "block", ("n", "doc_ids", "ends", "data")):
            _, ids, ends, data = held[0]  # the block itself; its answers follow by order and bucket
            grams = _Grams(ends, data)
            others = {n: np.concatenate([np.zeros(0, np.int64), *(_unpacked(x.as_py()) for k, _, _, x in held[1:] if k.as_py() == n)]) for n in range(1, ORDER + 1)}
            found, n_words = _scores(grams, others, total, backoff), grams.words
            mean = pa.array(found / np.maximum(n_words, 1), mask=n_words == 0)
            yield pa.record_batch([ids.values, pa.array(n_words, pa.int64()), pa.array(found), mean], [c.split()[0] for c in _RESULT.split(", ")])

    return rows.repartition("block").sortWithinPartitions("block", "n", "bucket").mapInArrow(score, _RESULT)
