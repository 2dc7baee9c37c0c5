"""Quality rules: plain text statistics, and a hashed n-gram logistic regression over them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, keep_rows, labelled_sample, pick, runs

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: The verdict's threshold: the calibrated probability of low quality at which a document goes.
REJECT_AT = 0.5
#: Hash buckets of word n-grams (1 and 2 words) and of character n-grams (1 and 3 code points), each.
BUCKETS = 1 << 16
#: The classifier is fitted on about so many labelled rows, those with the lowest hashes of doc_id, of longer texts on a
#: window of so many characters. Only the fit is bounded: every row of the input is scored, whole.
FIT_ROWS = 6000
FIT_CHARS = 30_000
EPOCHS = 12

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, low_quality double"
)


_BLANKS = " \t\n\x0b\x0c\r"
_MARKS = "#*$%&|<>"
_MIX = np.uint32(2654435761)


def statistics(text: str | None, words: Words | None = None, ids: np.ndarray | None = None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text.

    bytes.split() parts at the six ASCII blanks alone, as the words' definition asks.
    """
    text = text or ""
    words = words or Words()
    ids = words.of(text) if ids is None else ids
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(_BLANKS):
            seen.add(line)
    return len(ids), len(text) - sum(map(text.count, _BLANKS)), sum(map(text.count, _MARKS)), dup, _repeated(ids, len(words.numbers))


def _repeated(ids: np.ndarray, n: int) -> int:
    """Words that lie in a window of three found twice or more."""
    if len(ids) < 4:
        return 0
    pair = ids[:-1] * n + ids[1:]
    if n**3 >= 1 << 63:  # renumbered, pairs are as few as the text is long
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * n + ids[2:]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(key, twice)
    covered = np.zeros(len(ids), bool)
    for i in range(3):
        covered[i : i + len(hit)] |= hit
    return int(covered.sum())


def _bucket(h: np.ndarray, part: int) -> np.ndarray:
    return ((h * _MIX) >> np.uint32(16)).astype(np.int32) + np.int32(part * BUCKETS)


def ngrams(text: str | None, words: Words | None = None, ids: np.ndarray | None = None) -> list[np.ndarray]:
    """The feature buckets of a text, repeats included, in four parts: word 1- and 2-grams, characters, their trigrams."""
    text = text or ""
    words = words or Words()
    ids = words.of(text) if ids is None else ids
    h = words.hashes[ids]
    c = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    trigrams = (c[:-2] * np.uint32(0x01000193) + c[1:-1]) * np.uint32(0x01000193) + c[2:]
    return [_bucket(h, 0), _bucket(h[:-1] * np.uint32(31) + h[1:], 1), _bucket(c, 2), _bucket(trigrams, 3)]


@dataclass
class QualityModel:
    """P(low quality) = sigmoid(scale * margin + shift), margin = the mean weight in each feature part, summed."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def margin(self, parts: list[np.ndarray]) -> float:
        """Each part adds the mean of its weights."""
        return self.bias + sum(float(self.weights[x].mean(dtype=np.float64)) for x in parts if len(x))

    def probability(self, text: str | None, words: Words | None = None, ids: np.ndarray | None = None) -> float:
        z = self.scale * self.margin(ngrams(text, words, ids)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """AdaGrad over sparse rows (bucket, share); both classes carry the same total weight."""
    w, g, b, gb = np.zeros(4 * BUCKETS), np.full(4 * BUCKETS, 1e-8), 0.0, 1e-8
    cost = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            at, share = rows[i]
            d = cost[i] * (1 / (1 + np.exp(-np.clip(b + w[at] @ share, -50, 50))) - y[i])
            step = d * share + 1e-6 * w[at]
            g[at] += step * step
            w[at] -= 0.3 * step / np.sqrt(g[at])
            gb += d * d
            b -= 0.1 * d / np.sqrt(gb)
    return w, b


def _sparse(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found = [np.unique(x, return_counts=True) for x in parts if len(x)]
    return np.concatenate([at for at, _ in found]), np.concatenate([n / n.sum() for _, n in found])


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> QualityModel:
    """Fit on labelled rows (quality 1 good, 0 bad), then calibrate on a fifth of them held out (Platt).

    Rows with a null label or key are left out; where one class is missing the model keeps everything.
    A key labelled several times counts once, as bad if any label says so. Equal texts count once.
    """
    sample = labelled_sample(docs, labels, "quality", fit_rows, FIT_CHARS, worst=F.min)
    unique = list({r.text: r for r in sample}.values())
    y = np.array([r.label == 0 for r in unique], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return QualityModel(np.zeros(4 * BUCKETS, np.float32), -10.0, 1.0, 0.0)
    x = [_sparse(ngrams(r.text)) for r in unique]
    held = np.arange(len(y)) % 5 == 4
    fit, test = np.nonzero(~held)[0], np.nonzero(held)[0]
    w, b = _descend([x[i] for i in fit], y[fit])
    margin = np.array([b + w[x[i][0]] @ x[i][1] for i in test])
    return QualityModel(w.astype(np.float32), b, *_platt(margin, y[test]))


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """scale and shift by Newton's method, with Platt's softened targets."""
    n1, n0 = int(y.sum()), int((1 - y).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(y))], axis=1)
    a = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        a -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(a[0]), float(a[1])) if a[0] > 0 else (1.0, 0.0)


def _judge(texts: list[str | None], model: QualityModel, reject_at: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts, base_failed, kept and low_quality of a run of texts."""
    words, counts, low = Words(), np.zeros((len(texts), 5), np.int64), np.zeros(len(texts))
    for i, text in enumerate(texts):
        ids = words.of(text or "")
        counts[i] = statistics(text, words, ids)
        low[i] = model.probability(text, words, ids)
    failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
    return counts, failed, ~failed & (low < reject_at), low


def assess(spark: SparkSession, docs: DataFrame, model: QualityModel, reject_at: float = REJECT_AT) -> DataFrame:
    """Statistics, rule result and verdict of every document, in one pass and without a shuffle.

    Result: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (under 50
    words, or over half of them in repeated 3-word windows), kept (the base rules and the model agree to
    keep it), low_quality (calibrated probability).

    Null and empty texts have zero counts, fail the base rules and are not kept. Repeated rows are
    judged alike. An empty table gives an empty result. Other columns are ignored.
    """
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            counts, failed, kept, low = _judge(batch.column("text").to_pylist(), shared.value, reject_at)
            columns = [batch.column("doc_id"), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(kept), pa.array(low)]
            yield pa.record_batch(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return pick(docs, doc_id="doc_id", text="text").mapInArrow(score, SCHEMA)


def keep_good(spark: SparkSession, docs: DataFrame, model: QualityModel, reject_at: float = REJECT_AT) -> DataFrame:
    """The documents that are kept, with all their columns, decided where they lie. Null and empty texts go, rows that
    repeat are judged alike, an empty table stays empty; a text of any length is judged as a whole, in its batch."""
    shared = spark.sparkContext.broadcast(model)
    return keep_rows(docs, "text", lambda texts: _judge(texts, shared.value, reject_at)[2].tolist())
