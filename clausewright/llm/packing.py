"""Best-fit packing through a configuration linear program over the histogram of piece lengths."""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import TEXTS, kept, materialize, pick, runs, trim

CAPACITY = 4096
END_ID = 1
#: The configuration program is played in two phases: how fast a covered length gets cheaper, the share of its pieces that
#: a step covers, and the steps at most. Slow prices give the bound, fast ones the bins.
PHASES = ((1.0, 0.02, 160), (8.0, 0.1, 400))
#: The gap between bins and bound at which the program ends.
GAP = 0.002
#: Different sizes in one program, and how often it is solved anew for the pieces that rounding left.
CLASSES, DIVES = 128, 4
#: Pieces that one numbering group holds on average.
GROUP_ROWS = 4096

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
RESULT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
Pattern = tuple[tuple[int, int], ...]


class WordEncoder:
    """Token ids of whole texts, word by word, as bytes of little-endian unsigned 32-bit numbers.

    The tokenizer parts words at white space before anything else, so a text's ids are its blank-separated
    words' ids in a row; each distinct word is encoded once and then looked up. A word of Latin letters and
    then ASCII marks (no apostrophe) parts between the two: its letters go to the BPE model at once, small
    and in the byte alphabet, so that its forms are encoded once. All other words take the whole way.
    """

    KEEP, LONG = 600_000, 64
    _PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {"": b""}
        self.alphabet = {i: c for i, c in zip(range(256), _byte_alphabet(), strict=True)}

    def _whole(self, word: str) -> bytes:
        return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        plain = self._PLAIN(word)
        if not plain:
            return self._whole(word)
        stem = plain[1].lower()
        if (ids := self.stems.get(stem)) is None:
            if len(self.stems) > self.KEEP:
                self.stems.clear()
            letters = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.alphabet)
            ids = self.stems[stem] = _packed([t.id for t in self.model.tokenize(letters)])
        marks = plain[2]
        if (end := self.ends.get(marks)) is None:
            end = self._whole(marks)
            if len(marks) < 8 and len(self.ends) < 10_000:
                self.ends[marks] = end
        return ids + end

    def encode(self, text: str | None) -> bytes:
        known, out = self.known, []
        for w in text.encode().split() if text else ():
            ids = known.get(w)
            if ids is None:
                ids = self._word(w.decode())
                if len(w) <= self.LONG:
                    if len(known) > self.KEEP:
                        known.clear()
                    known[w] = ids
            out.append(ids)
        return b"".join(out)


def _packed(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


def _byte_alphabet() -> list[str]:
    """The printable stand-ins of the byte-level alphabet: printable bytes stand for themselves, the others
    follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def encoder(path: str) -> WordEncoder:
    """One encoder, with what it has looked up, for all tasks of a worker that follow each other."""
    return kept(("words", path), lambda: WordEncoder(path))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document's ids and the end id, cut at the capacity.

    A null or empty text is the end id alone, a very long one many pieces; one text's ids are held at a time. Repeated
    rows have pieces each. An empty table gives an empty result. Other columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes()
        for batch in runs(batches):
            rows, held = [], []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = encode(text) + end
                for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc, k, start, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        held.append(np.frombuffer(part, "<i4"))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            if with_ids:
                columns.append(pa.array(held, pa.list_(pa.int32())))
            yield pa.record_batch(columns, [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids)

    return pick(docs, doc_id="doc_id", text="text").mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def _knapsack(size: np.ndarray, most: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """How many of each size, `most` of them at most, make the dearest load, and its price. Dynamic programming over all
    loads up to the capacity; a size's copies are taken by powers of two."""
    best = np.zeros(capacity + 1)
    items, took = [], []
    for i, (s, m, p) in enumerate(zip(size.tolist(), most.tolist(), price.tolist(), strict=True)):
        k = 1
        while m > 0 and s * min(k, m) <= capacity:
            k = min(k, m)
            with_it = best[: capacity + 1 - s * k] + p * k
            better = with_it > best[s * k :]
            best[s * k :][better] = with_it[better]
            items.append((i, k))
            took.append(better)
            m, k = m - k, 2 * k
    chosen, room = np.zeros(len(size), np.int64), capacity
    for (i, k), better in zip(reversed(items), reversed(took), strict=True):
        if (load := int(size[i]) * k) <= room and better[room - load]:
            chosen[i] += k
            room -= load
    return chosen, float(best[capacity])


def solve(size: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> tuple[dict[tuple[int, ...], float], float, float]:
    """The configuration program for pieces of few different sizes: bins for each configuration (copies of each size),
    their sum, and a lower bound of any packing.

    Multiplicative weights: a size is dearer the less of it is covered so far (its price is its length times
    exp(-speed * covered share)); a knapsack over all sizes prices the best configuration, which gets bins until one of its
    sizes is covered by a share of `pace` more. The bins, divided by the least covered share, cover all pieces. Prices divided
    by their knapsack's value are dual and bound any packing from below, as does their mean by bins, which is the better one
    where prices move slowly. It ends where bins and bound differ by GAP, or after the phases' steps; work does not depend on
    the number of pieces.
    """
    n = counts.astype(np.float64)
    most = np.minimum(capacity // size, counts)
    least, bound = np.inf, float((size * n).sum() / capacity)
    best: dict[tuple[int, ...], float] = {}
    for speed, pace, steps in PHASES:
        x: dict[tuple[int, ...], float] = defaultdict(float)
        covered, mean, total = np.zeros(len(size)), np.zeros(len(size)), 0.0
        for _ in range(steps):
            price = size * np.exp(-speed * (covered - covered.min()))
            chosen, value = _knapsack(size, most, price, capacity)
            bound = max(bound, float((price * n).sum() / value))
            at = np.flatnonzero(chosen)
            bins = pace * (n[at] / chosen[at]).min()
            mean += price / value * bins
            x[tuple(chosen.tolist())] += bins
            total += bins
            covered[at] += bins * chosen[at] / n[at]
            if covered.min() > 0 and total / covered.min() < least:
                least = total / covered.min()
                best = {k: v / covered.min() for k, v in x.items()}
            if least <= bound * (1 + GAP):
                return best, least, bound
        bound = max(bound, float((mean * n).sum() / _knapsack(size, most, mean, capacity)[1]))
    return best, least, bound


def _classes(left: dict[int, int]) -> list[list[int]]:
    """Classes of lengths, each the longest first: the most frequent lengths by themselves, the others in runs of like
    area. At most CLASSES of them; up to so many different lengths have a class each."""
    own = set(sorted(left, key=lambda x: (-left[x] * x, x))[: CLASSES if len(left) <= CLASSES else CLASSES // 2])
    found, run, held = [[x] for x in own], [], 0
    others = sorted((x for x in left if x not in own), reverse=True)
    share = sum(x * left[x] for x in others) / (CLASSES - CLASSES // 2)
    for x in others:
        run.append(x)
        held += x * left[x]
        if held >= share:
            found.append(run)
            run, held = [], 0
    return found + [run] * bool(run)


def _filled(config: tuple[int, ...], n: int, classes: list[list[int]], left: dict[int, int]) -> list[tuple[Pattern, int]]:
    """n bins of a configuration, filled with the longest pieces that are left of each class; they are taken from left."""
    slots = []
    for members, times in zip(classes, config, strict=True):
        for _ in range(times):
            wanted, ends, at = n, [], 0
            for length in members:
                took = min(wanted, left[length])
                left[length] -= took
                wanted, at = wanted - took, at + took
                if took:
                    ends.append((at, length))
                if not wanted:
                    break
            slots.append(ends)
    bins, at, place = [], 0, [0] * len(slots)
    while at < n:
        to = min(ends[k][0] for ends, k in zip(slots, place, strict=True))
        bins.append((tuple(Counter(ends[k][1] for ends, k in zip(slots, place, strict=True)).items()), to - at))
        place = [k + (ends[k][0] == to) for ends, k in zip(slots, place, strict=True)]
        at = to
    return bins


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[Pattern, int]], float, float]:
    """Bins (lengths with their numbers; how many bins), the fractional program's value and a lower bound.

    Best fit decreasing is the first plan, and as good as any where it meets the pieces' area. Else the configuration
    program is solved, its configurations are rounded down to whole bins, and it is solved anew for the pieces that are
    left; in the end best fit puts the rest into the bins' room and into new bins. The plan with fewer bins is returned.
    Where there are over CLASSES different lengths, the program takes classes of lengths, as long as their longest.
    """
    first = _best_fit(dict(histogram), capacity)
    area = sum(x * n for x, n in histogram.items()) / capacity
    count = lambda bins: sum(n for _, n in bins)
    if count(first) <= np.ceil(area):
        return first, float(count(first)), area
    left, bins, value, bound = dict(histogram), [], np.inf, area
    for dive in range(DIVES):
        classes = _classes({x: n for x, n in left.items() if n})
        size = np.array([c[0] for c in classes], np.int64)
        config, least, low = solve(size, np.array([sum(left[x] for x in c) for c in classes], np.int64), capacity)
        if dive == 0:
            value, bound = least, max(bound, low) if all(len(c) == 1 for c in classes) else bound
        done = len(bins)
        for chosen, share in sorted(config.items(), key=lambda c: (-c[1], c[0])):
            room = (sum(left[x] for x in members) // times for members, times in zip(classes, chosen, strict=True) if times)
            if (n := min(int(share + 1e-9), *room)) > 0:
                bins += _filled(chosen, n, classes, left)
        if len(bins) == done or not any(left.values()):
            break
    second = _best_fit({x: n for x, n in left.items() if n}, capacity, bins)
    best = min(first, second, key=count)
    return best, min(value, float(count(best))), bound


def _best_fit(left: dict[int, int], capacity: int, bins: list[tuple[Pattern, int]] = ()) -> list[tuple[Pattern, int]]:
    """Best fit decreasing over a histogram, into given bins and new ones: like bins are one entry with a count."""
    open_bins: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append((pattern, n))

    for pattern, n in bins:
        put(capacity - sum(a * b for a, b in pattern), pattern, n)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                pattern, same = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            else:
                room, pattern, same = capacity, (), n
            times = min(room // length, n)
            used = min(same, n // times)
            if same > used and pattern:
                put(room, pattern, same - used)
            put(room - times * length, (*pattern, (length, times)), used)
            n -= used * times
    return [entry for room in rooms for entry in open_bins[room]]


def _places(bins: list[tuple[Pattern, int]]) -> tuple[np.ndarray, ...]:
    """For the pieces of each length, by rank: from which rank on a configuration's places are taken.

    key (length and first rank), first rank, first sequence, places in a bin, offset of the first place.
    """
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, n in bins:
        offset = 0
        for length, times in pattern:
            rows.append(((length << 44) + taken[length], taken[length], sequence, times, offset))
            taken[length] += n * times
            offset += length * times
        sequence += n
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every document's tokens in sequences of at most `capacity`: doc_id, piece, start, length, ids_crc32,
    sequence_id (from 0, dense), offset (gapless in each sequence).

    Only the histogram of lengths (at most `capacity` rows) reaches the driver, and only the table of
    places (a few rows for each configuration) goes back. Pieces are ranked within their length through
    (length, bucket) groups and a table of counts, so a length that many copies share is no hot task.

    A null or empty text is the end id alone. Repeated rows are packed each. An empty table gives an empty
    result. Other columns are ignored.
    """
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_id), "pieces", TEXTS)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(plan(histogram, capacity)[0]))
    many = [(x, -(-n // GROUP_ROWS)) for x, n in sorted(histogram.items())]  # as an Arrow table: rows would take Python workers of their own
    groups = spark.createDataFrame(pa.table({"length": pa.array([x for x, _ in many], pa.int32()), "groups": pa.array([g for _, g in many], pa.int64())}))
    # The pieces lie in a table, so a row has the same number each time it is read; equal rows have different ones.
    rows = pieces.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(groups), "length")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("groups"))).drop("groups")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    firsts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("length", "bucket").orderBy("row")
    ranked = rows.withColumn("rank", F.row_number().over(order)).join(firsts, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("first") + F.col("rank") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        key, first, sequence, times, offset = places.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            nth = rank - first[at]
            columns = [*batch.columns[:5], pa.array(sequence[at] + nth // times[at]), pa.array(offset[at] + nth % times[at] * length)]
            yield pa.record_batch(columns, [c.split()[0] for c in RESULT.split(", ")])

    return ranked.mapInArrow(place, RESULT)
