"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, labelled_sample, pick, runs

#: The field is fitted on about so many labelled rows, of longer texts on a window of so many characters. Only the fit
#: is bounded: every row of the input is scored, whole.
FIT_ROWS = 6000
FIT_CHARS = 20_000
#: Token labels are distant supervision, as documents alone are labelled. A word counts as a toxic token if at least this
#: share of the fit's documents with it (unlike ones) is toxic, and if by chance alone, over all words, fewer words than
#: this would be found. Where no word is that sure, the FEW surest of those in two toxic documents or more are taken.
LEAST_SHARE, CHANCE, FEW = 0.8, 3.0, 10
#: Training sequences: windows of so many words, and so many windows without a toxic token for one with.
WINDOW, CLEAN_WINDOWS = 48, 3
EPOCHS = 60
HASHES = 1 << 18
SPAN_AT = 0.5
#: Documents are read in runs of about so many tokens; the marginals of a token take about 300 bytes meanwhile.
RUN_TOKENS = 1 << 18
_TOKENS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TOKEN = re.compile("[A-Za-z0-9\x80-\U0010ffff]+")
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_toxic long, span_starts array<int>, span_ends array<int>"


def tokens(text: str | None) -> list[bytes]:
    return text.encode().translate(_TOKENS).split() if text else []


def _interned(texts: Iterable[str | None]) -> list[list[bytes]]:
    """The tokens of texts, equal ones as one object."""
    known: dict[bytes, bytes] = {}
    return [[known.setdefault(w, w) for w in tokens(t)] for t in texts]


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def _features(word: bytes) -> tuple[int, int, int, int, int]:
    """Weights of a token: itself, its first and last three characters; and what it says of its neighbours."""
    said = word.decode()
    parts = (b"w" + word, b"p" + said[:3].encode(), b"s" + said[-3:].encode(), b"<" + word, b">" + word)
    return tuple(zlib.crc32(p) % HASHES for p in parts)


@dataclass
class ToxicityModel:
    """State 1 is toxic. weights: log-odds of hashed features; start, step: log-potentials of states."""

    weights: np.ndarray
    start: np.ndarray
    step: np.ndarray
    aggregate: np.ndarray

    def emissions(self, words: Words, ids: np.ndarray, first: np.ndarray, cache: dict) -> np.ndarray:
        """Log-odds of state 1 for each token of a stream; first: where documents begin."""
        table = cache.setdefault("table", np.zeros((0, 3), np.float64))
        if len(words.numbers) > len(table):
            fresh = list(words.numbers)[len(table) :]
            at = np.array([_features(w) for w in fresh], dtype=np.int64).reshape(-1, 5)
            w = self.weights[at]
            table = cache["table"] = np.concatenate((table, np.stack([w[:, :3].sum(axis=1), w[:, 3], w[:, 4]], axis=1)))
        rows = table[ids]
        out = rows[:, 0].copy()
        out[1:] += np.where(first[1:], 0, rows[:-1, 1])
        out[:-1] += np.where(first[1:], 0, rows[1:, 2])
        return out

    def marginals(self, odds: np.ndarray, first: np.ndarray, block: int = 128) -> np.ndarray:
        """P(state 1) of every token: forward and backward products of 2 x 2 matrices, in blocks side by side.

        A document's first matrix forgets what came before, so documents of any length share one stream.
        """
        n = len(odds)
        if not n:
            return odds
        e = np.exp(np.clip(odds, -30, 30))
        step, start = np.exp(self.step), np.exp(self.start)
        m = np.empty((4, n))
        for i in range(2):
            m[2 * i] = np.where(first, start[0], step[i, 0])
            m[2 * i + 1] = np.where(first, start[1], step[i, 1]) * e
        blocks = -(-n // block)
        pad = np.tile(np.array([1.0, 0, 0, 1])[:, None], blocks * block - n)
        m = np.concatenate((m, pad), axis=1).reshape(4, blocks, block).transpose(2, 0, 1).copy()
        prefix, suffix = np.empty_like(m), np.empty_like(m)
        run = np.tile(np.array([1.0, 0, 0, 1])[:, None], blocks)
        for k in range(block):
            run = prefix[k] = _times(run, m[k])
        run = np.tile(np.array([1.0, 0, 0, 1])[:, None], blocks)
        for k in range(block - 1, -1, -1):
            suffix[k] = run  # what follows position k in the block
            run = _times(m[k], run)
        before, after = np.empty((2, blocks)), np.empty((2, blocks))
        a0, a1 = 0.5, 0.5
        totals = prefix[-1].T.tolist()
        for b, (p, q, r, s) in enumerate(totals):
            before[:, b] = a0, a1
            a0, a1 = a0 * p + a1 * r, a0 * q + a1 * s
            a0, a1 = a0 / (a0 + a1), a1 / (a0 + a1)
        b0, b1 = 0.5, 0.5
        for b in range(blocks - 1, -1, -1):
            after[:, b] = b0, b1
            p, q, r, s = totals[b]
            b0, b1 = p * b0 + q * b1, r * b0 + s * b1
            b0, b1 = b0 / (b0 + b1), b1 / (b0 + b1)
        alpha0 = before[0] * prefix[:, 0] + before[1] * prefix[:, 2]
        alpha1 = before[0] * prefix[:, 1] + before[1] * prefix[:, 3]
        beta0 = suffix[:, 0] * after[0] + suffix[:, 1] * after[1]
        beta1 = suffix[:, 2] * after[0] + suffix[:, 3] * after[1]
        on = alpha1 * beta1
        return (on / (on + alpha0 * beta0)).T.reshape(-1)[:n]

    def read(self, texts: list[list[bytes]]) -> tuple[list[np.ndarray], np.ndarray]:
        """Token marginals of each text, and the document scores."""
        words, cache, parts = Words(), {}, []
        for some in _token_runs(texts):
            sizes = np.array([len(t) for t in some], dtype=np.int64)
            ids = words.numbered([w for t in some for w in t])
            first = np.zeros(len(ids), bool)
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            first[bounds[:-1][sizes > 0]] = True
            p = self.marginals(self.emissions(words, ids, first, cache), first)
            parts += [p[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return parts, self.score(parts)

    def score(self, parts: list[np.ndarray]) -> np.ndarray:
        z = _aggregates(parts) @ self.aggregate
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _token_runs(texts: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    """The texts in runs that end where RUN_TOKENS are reached; a text is never split."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= RUN_TOKENS:
            yield texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.stack([a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]])
    return out / out.max(axis=0)


def _aggregates(parts: list[np.ndarray]) -> np.ndarray:
    """Of a document's marginals: the highest, the expected number of toxic tokens and their share; and 1."""
    return np.array([(p.max(), np.log1p(p.sum()), p.mean(), 1.0) if len(p) else (0.0, 0.0, 0.0, 1.0) for p in parts]).reshape(-1, 4)


def _unlike(texts: list[list[bytes]]) -> np.ndarray:
    """True for texts that share none of four least hashes of word 3-grams with an earlier one."""
    seen: set[tuple[int, int]] = set()
    keep = []
    for t in texts:
        h = np.array([zlib.crc32(b" ".join(t[i : i + 3])) for i in range(max(1, len(t) - 2))], dtype=np.uint32)
        keys = [(k, int((h * np.uint32(m) + np.uint32(k)).min())) for k, m in enumerate((1, 2654435761, 2246822519, 3266489917))]
        keep.append(not any(k in seen for k in keys))
        seen.update(keys)
    return np.array(keep, bool)


def _windows(texts: list[list[bytes]], toxic: np.ndarray, lexicon: set[bytes], rng: np.random.Generator) -> tuple[list[list[bytes]], list[list[int]]]:
    """Training sequences and their token labels."""
    hot, clean = [], []
    for t, y in zip(texts, toxic, strict=True):
        for i in range(0, len(t), WINDOW):
            (hot if y and not lexicon.isdisjoint(t[i : i + WINDOW]) else clean).append((t, i, y))
    pick_n = min(len(clean), max(200, CLEAN_WINDOWS * len(hot)))
    chosen = hot + [clean[i] for i in rng.permutation(len(clean))[:pick_n]]
    parts = [t[i : i + WINDOW] for t, i, _ in chosen]
    return parts, [[int(y and w in lexicon) for w in part] for part, (_, _, y) in zip(parts, chosen, strict=True)]


def _fit_field(texts: list[list[bytes]], labels: list[list[int]]) -> ToxicityModel:
    """Maximum likelihood by AdaGrad; expectations come from forward-backward over padded windows."""
    n, width = len(texts), max(map(len, texts))
    at = np.full((5, n, width), HASHES, dtype=np.int32)  # the last row of weights stays zero
    y, inside = np.zeros((n, width), np.int8), np.zeros((n, width), bool)
    for i, (t, marks) in enumerate(zip(texts, labels, strict=True)):
        own = np.array([_features(w) for w in t], dtype=np.int32).T
        at[:3, i, : len(t)] = own[:3]
        at[3, i, 1 : len(t)] = own[3, :-1]
        at[4, i, : len(t) - 1] = own[4, 1:]
        y[i, : len(t)], inside[i, : len(t)] = marks, True
    there = np.zeros(HASHES + 1, bool)
    there[at] = True
    used = np.flatnonzero(there)
    index = (np.cumsum(there, dtype=np.int32) - 1)[at]
    del at
    w, start, step = np.zeros(len(used)), np.zeros(2), np.zeros((2, 2))
    gw, gs, gt = np.full(len(used), 1e-6), np.full(2, 1e-6), np.full((2, 2), 1e-6)
    last = used == HASHES
    for _ in range(EPOCHS):
        odds = sum(w[part] for part in index)
        alpha, beta = np.zeros((width, n, 2)), np.ones((width, n, 2))
        e = np.exp(np.clip(np.stack([np.zeros_like(odds), odds], axis=2), -30, 30)).transpose(1, 0, 2)
        e[~inside.T] = 1
        s, t = np.exp(start), np.exp(step)
        for k in range(width):
            a = (s if k == 0 else alpha[k - 1] @ t) * e[k]
            if k:
                a = np.where(inside[:, k, None], a, alpha[k - 1])
            alpha[k] = a / a.sum(axis=1, keepdims=True)
        for k in range(width - 2, -1, -1):
            b = (beta[k + 1] * e[k + 1]) @ t.T
            b = np.where(inside[:, k + 1, None], b, beta[k + 1])
            beta[k] = b / b.sum(axis=1, keepdims=True)
        p = alpha * beta
        p /= p.sum(axis=2, keepdims=True)
        miss = np.where(inside, p[:, :, 1].T - y, 0)
        g = sum(np.bincount(part.ravel(), weights=miss.ravel(), minlength=len(used)) for part in index) / n + 1e-5 * w
        g[last] = 0
        pair = np.zeros((2, 2))
        for k in range(1, width):
            ok = inside[:, k]
            joint = alpha[k - 1][ok][:, :, None] * t * (e[k] * beta[k])[ok][:, None, :]
            pair += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        seen = np.zeros((2, 2))
        both = inside[:, 1:]
        np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
        d_step = (pair - seen) / n + 1e-4 * step
        d_start = (p[0].sum(axis=0) - np.bincount(y[:, 0], minlength=2)) / n + 1e-4 * start
        for x, dx, gx in ((w, g, gw), (start, d_start, gs), (step, d_step, gt)):
            gx += dx * dx
            x -= 0.5 * dx / np.sqrt(gx)
    weights = np.zeros(HASHES)
    weights[used[~last]] = w[~last]
    return ToxicityModel(weights, start, step, np.array([0.0, 0.0, 0.0, -3.0]))


def _fit_aggregate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression on the aggregates by Newton's method with a ridge."""
    a = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -50, 50)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(a))
        step = np.linalg.solve(hessian, x.T @ (p - y) + 0.5 * a)
        a -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return a


def _lexicon(seen: Counter, bad: Counter, rate: float) -> set[bytes]:
    """The toxic words: a word counts if a binomial test, at the rate of all documents, expects fewer than
    CHANCE words as surely toxic as it among all words of toxic documents."""

    def chance(w: bytes) -> float:
        n, k = seen[w], bad[w]
        return sum(comb(n, j) * rate**j * (1 - rate) ** (n - j) for j in range(k, n + 1))

    tested = {w: chance(w) for w, k in bad.items() if k >= 2 and k >= LEAST_SHARE * seen[w] and rate < 1}
    sure = {w for w, p in tested.items() if p * len(bad) < CHANCE}
    return sure or set(sorted(tested, key=lambda w: (tested[w], w))[:FEW])


def fit(texts: list[list[bytes]], toxic: np.ndarray, seed: int = 5) -> ToxicityModel:
    """Token labels from document labels, the field on the tokens, the aggregation on the documents."""
    keep = _unlike(texts)
    texts, toxic = [t for t, k in zip(texts, keep, strict=True) if k], toxic[keep]
    seen, bad = Counter(), Counter()
    for t, y in zip(texts, toxic, strict=True):
        seen.update(set(t))
        if y:
            bad.update(set(t))
    lexicon = _lexicon(seen, bad, float(toxic.mean()) if len(texts) else 0.0)
    none = ToxicityModel(np.zeros(HASHES), np.zeros(2), np.zeros((2, 2)), np.array([0.0, 0.0, 0.0, -3.0]))
    if not texts or len(set(toxic.tolist())) < 2 or not lexicon:
        return none
    model = _fit_field(*_windows(texts, toxic, lexicon, np.random.default_rng(seed)))
    model.aggregate = _fit_aggregate(_aggregates(model.read(texts)[0]), toxic)
    return model


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Fit on rows that are not held out. Rows with a null label or key are left out; a key labelled several
    times counts as toxic if any label says so. With one class alone, or if no word occurs in two toxic documents, every
    score is low."""
    sample = labelled_sample(docs, labels, "toxic", fit_rows, FIT_CHARS, worst=F.max, where=~held_out(F.col("doc_id")))
    texts, toxic = _interned(r.text for r in sample), np.array([int(r.label == 1) for r in sample], dtype=np.int64)
    del sample
    return fit(texts, toxic)


def score(spark: SparkSession, docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Scores and offending spans of every whole text, in one pass and without a shuffle.

    Result: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5), n_toxic (tokens tagged),
    span_starts and span_ends (code points; neighbouring tagged tokens form one span).

    Null and empty texts have no tokens: they get the score of a document without toxic tokens and no
    spans. A null doc_id has held_out false. Repeated rows score alike. An empty table gives an empty
    result. Other columns are ignored.
    """
    shared = spark.sparkContext.broadcast(model)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in runs(batches):
            texts = batch.column("text").to_pylist()
            parts, scores = known.read([tokens(t) for t in texts])
            starts, ends, n = [], [], []
            for text, p in zip(texts, parts, strict=True):
                on = p >= SPAN_AT
                n.append(int(on.sum()))
                places = [m.span() for m in _TOKEN.finditer(text)] if n[-1] else []
                edge = np.diff(np.concatenate(([0], on.astype(np.int8), [0])))
                starts.append([places[i][0] for i in np.nonzero(edge == 1)[0]])
                ends.append([places[i - 1][1] for i in np.nonzero(edge == -1)[0]])
            spans = [pa.array(x, pa.list_(pa.int32())) for x in (starts, ends)]
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(n, pa.int64()), *spans]
            yield pa.record_batch(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    rows = pick(docs, doc_id="doc_id", text="text")
    return rows.select("doc_id", "text", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")).mapInArrow(tag, SCHEMA)
