"""SimHash near-duplicates through a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat, materialize, pick, runs

SHINGLE = 3
BITS = 2
SEED = 42
#: Postings of at most so many members compare all that meet.
SMALL = 200
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash: a bit is 1 if set in over half of the shingles' XXH64 values."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    hashes = np.array([digest(flat[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, mark (a hash of the text) and fp (the fingerprint as a signed long) of every row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("mark"), pa.array(found.view(np.int64))], ["doc_id", "mark", "fp"])

    rows = pick(docs, doc_id="doc_id", text="text").select("doc_id", "text", F.xxhash64("text").alias("mark"))
    return rows.mapInArrow(compute, "doc_id long, mark long, fp long")


def _masks(bits: int) -> list[int]:
    """For each choice of the byte positions that a pair at `bits` bits shares at the least, their mask."""
    chosen = combinations(range(8), 8 - bits)
    as_signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [as_signed(sum(0xFF << 8 * p for p in c)) for c in chosen]


def _near(bits: int) -> np.ndarray:
    """The changes of at most `bits` bits within the 8 * bits bits that a posting leaves open."""
    open_bits = 8 * bits
    return np.array([sum(1 << i for i in c) for n in range(1, bits + 1) for c in combinations(range(open_bits), n)], dtype=np.int64)


def _open(fps: np.ndarray, mask: int, bits: int) -> np.ndarray:
    """The bytes that the mask leaves open, side by side."""
    places = [p for p in range(8) if not (mask >> 8 * p) & 0xFF]
    return sum(((fps >> np.uint64(8 * p)) & np.uint64(0xFF)).astype(np.int64) << 8 * i for i, p in enumerate(places[:bits]))


def _posting_links(fps: np.ndarray, mask: int, bits: int, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within one posting, as stars: each fingerprint with the least one that it reaches there.

    All members share the byte positions of the mask; a pair is verified by the bits in which the open
    bytes differ. A posting holds at most 2^(8 * bits) fingerprints, and each looks up its few possible
    neighbours in a table of the open bytes, so the work follows the posting's size, not its square.
    """
    rest = _open(fps, mask, bits)
    table = np.full(1 << 8 * bits, -1, dtype=np.int64)
    table[rest] = np.arange(len(fps))
    left, right = [], []
    for change in near:
        other = table[rest ^ change]
        hit = np.nonzero(other > np.arange(len(fps)))[0]
        left.append(hit)
        right.append(other[hit])
    a, b = np.concatenate(left), np.concatenate(right)
    root = np.arange(len(fps))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(fps))
    return fps[moved], fps[root[moved]]


def _tally(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of byte positions in which fingerprints are equal."""
    changed = x ^ y
    return sum((changed >> np.uint64(8 * p) & np.uint64(0xFF) == 0).astype(np.int8) for p in range(8))


def _small_links(fps: np.ndarray, bounds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within postings of at most SMALL members: the pairs that meet are tallied by their shared bytes, those that reach
    the guaranteed minimum are verified by their differing bits."""
    size = np.diff(bounds)
    keep = np.flatnonzero((size > 1) & (size <= SMALL))
    first, many = np.repeat(bounds[keep], size[keep]), np.repeat(size[keep], size[keep])
    at = first + np.arange(len(first)) - np.repeat(np.cumsum(size[keep]) - size[keep], size[keep])
    left, right = [fps[:0]], [fps[:0]]
    for step in range(1, int(many.max(initial=1))):
        rest = at - first >= step
        if not rest.any():
            break
        x, y = fps[at[rest]], fps[at[rest] - step]
        met = _tally(x, y) >= 8 - bits
        ok = met & (np.bitwise_count(x ^ y) <= bits)
        left.append(x[ok])
        right.append(y[ok])
        at, first = at[rest], first[rest]
    return np.concatenate(left), np.concatenate(right)


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """Verified links between different fingerprints (column fp, distinct): a, b, with a > b as signed longs.

    Two fingerprints that differ in at most `bits` bits share at least 8 - bits byte positions. Postings are
    kept for every choice of that many positions: a posting of one byte would hold 1/256 of all fingerprints, and
    its pairs could not be tallied. Pairs that meet are tallied by their shared positional bytes, retained if they reach the
    minimum, and verified by their bits. In postings of over SMALL members, which share the minimum by their key, each
    fingerprint looks its few possible neighbours up instead.
    """
    if not 1 <= bits <= 2:
        raise ValueError("bits must be 1 or 2: beyond, a posting is no longer bounded")
    masks, near = _masks(bits), _near(bits)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("shared")) for i, m in enumerate(masks)])).alias("k")
    postings = distinct.select("fp", keys).select("k.choice", "k.shared", "fp")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(choice, shared, fp):
            edge = np.nonzero((choice[1:] != choice[:-1]) | (shared[1:] != shared[:-1]))[0] + 1
            return np.concatenate(([0], edge, [len(fp)]))

        def found(choice, shared, fp):
            bounds = cut(choice, shared, fp)
            size = np.diff(bounds)
            x, y = _small_links(fp.view(np.uint64), bounds, bits)
            out = [(x.view(np.int64), y.view(np.int64))]
            for i in np.nonzero(size > SMALL)[0]:
                run = fp[bounds[i] : bounds[i + 1]].view(np.uint64)
                x, y = _posting_links(run, masks[choice[bounds[i]]], bits, near)
                if len(x):
                    out.append((x.view(np.int64), y.view(np.int64)))
            x, y = (np.concatenate(s) for s in zip(*out, strict=True))
            if len(x):
                yield pa.record_batch([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])

        held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for batch in batches:
            held = [np.concatenate((h, batch.column(i).to_numpy(zero_copy_only=False))) for i, h in enumerate(held)]
            keep = cut(*held)[-2]
            yield from found(*(h[:keep] for h in held))
            held = [h[keep:] for h in held]
        if len(held[0]):
            yield from found(*held)

    grouped = postings.repartition("choice", "shared").sortWithinPartitions("choice", "shared", "fp")
    return grouped.mapInArrow(verify, "a long, b long").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, root for every node of the edges (a, b): root is the least node that it reaches.

    Large-star and small-star steps alternate until nothing changes; each round is written to the shared
    folder, so lineage stays short and only counts reach the driver.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    seen = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        edges = materialize(small, label)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state


def named_groups(rows: DataFrame, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """fp, component_id, component_mark of each distinct fp of the rows (doc_id, mark, fp): the least doc_id of
    its component, nulls last, and of rows that share it the least mark. link: distinct fp to links (a, b)."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    least = rows.groupBy("fp").agg(F.min(first).alias("first"))
    roots = components(link(least.select("fp")), "simhash")
    linked = least.join(roots, least.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    linked = materialize(linked, "simhash")
    top = linked.groupBy("root").agg(F.min("first").alias("top"))
    return linked.join(top, "root").select("fp", F.col("top.doc_id").alias("component_id"), F.col("top.mark").alias("component_mark"))


def _grouped(docs: DataFrame, shingle: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints (doc_id, mark, fp) and their named groups."""
    rows = materialize(fingerprints(docs, shingle), "simhash")
    return rows, named_groups(rows, lambda distinct: links(distinct, bits))


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """A row per document: doc_id, fingerprint (hex), component_id (the least doc_id that it reaches).

    Documents link if their fingerprints differ in at most `bits` bits. Copies fall together at once, as
    equal fingerprints, and only distinct fingerprints enter the index.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Texts of fewer words
    than a shingle hash as a whole. Repeated doc_ids get a row each; a null doc_id is never the least of
    its component unless all are null. An empty table gives an empty result. Other columns are ignored.
    """
    rows, named = _grouped(docs, shingle, bits)
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One document of each component, with all its columns: the one with the least doc_id, nulls last.

    A row is found again by doc_id and text, so rows that share a doc_id but not the text are judged each
    by itself, and of rows that repeat both one stays. Null, empty and blank texts are copies of each other. An empty table
    gives an empty result, and other columns stay, whatever their names.
    """
    return keep_first(docs, *_grouped(docs, shingle, bits))


def keep_first(docs: DataFrame, rows: DataFrame, named: DataFrame) -> DataFrame:
    """The first document of each named group of the rows (doc_id, mark, fp), with all columns of docs."""
    kept = named.select(F.col("component_id").alias("__id"), F.col("component_mark").alias("__mark")).distinct()
    plain, at = flat(docs)
    marked = plain.withColumn("__text_mark", F.xxhash64(at["text"]))
    same = F.col(at["doc_id"]).eqNullSafe(F.col("__id")) & (F.col("__text_mark") == F.col("__mark"))
    chosen = marked.join(kept.hint("shuffle_hash"), same, "left_semi")
    if rows.groupBy("doc_id", "mark").count().where("count > 1").limit(1).count():
        chosen = chosen.dropDuplicates([at["doc_id"], "__text_mark"])
    return chosen.drop("__text_mark").toDF(*docs.columns)
