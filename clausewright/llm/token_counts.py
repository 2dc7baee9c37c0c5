"""Token counts of sections, from whole documents encoded once."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept, pick, runs

SCHEMA = "doc_id long, section int, start long, end long, n_tokens long, n_shared long"


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines as sections: each with the line break that ends it, so they cover the text without a gap."""
    ends = np.array([i for i in _breaks(text)] + ([len(text)] if text and text[-1] != "\n" else []), dtype=np.int64)
    return np.concatenate(([0], ends[:-1])) if len(ends) else ends, ends


def _breaks(text: str) -> Iterator[int]:
    at = text.find("\n")
    while at >= 0:
        yield at + 1
        at = text.find("\n", at + 1)


def attribute(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section.

    starts, ends: disjoint sorted sections. first, last: character spans of the tokens in order. Rule: a
    token belongs to the section that it overlaps most, of equal ones to the earliest; a token without
    width belongs to the section that its place lies in; one that meets no section counts nowhere.
    """
    n, shared = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    if not len(starts) or not len(first):
        return n, shared
    low = np.searchsorted(ends, first, side="right")  # the first section that ends after the token's start
    high = np.searchsorted(starts, np.maximum(last, first + 1), side="left")  # one past the last that starts before its end
    inside = high - low == 1
    n += np.bincount(low[inside], minlength=len(starts))
    for t in np.nonzero(high - low > 1)[0]:
        k = np.arange(low[t], high[t])
        overlap = np.minimum(ends[k], last[t]) - np.maximum(starts[k], first[t])
        best = k[int(overlap.argmax())]
        n[best] += 1
        shared[best] += 1
    return n, shared


class SpanEncoder:
    """Character spans of a text's tokens, from pieces that are encoded once and looked up afterwards.

    The byte-level tokenizer parts a text before each blank that a word follows, and around runs of other
    white space; no token crosses such a place and none depends on what lies beyond it. So a text's tokens
    are its pieces' tokens in a row. A piece of ASCII letters and then ASCII marks (no apostrophe) parts between
    the two, and its letters go to the BPE model at once. Texts with unusual white space are encoded whole.
    """

    KEEP, LONG = 400_000, 64
    _PIECES = re.compile(r" ?[^ \n\t\r]+|[ \n\t\r]+(?![^ \n\t\r])|[ \n\t\r]").findall
    _UNUSUAL = re.compile(r"[^\S \n\t\r]|[\x1c-\x1f\x85]").search
    _PLAIN = re.compile(r"( ?[A-Za-z]+)([!-&(-/:-@\[-`{-~]*)").fullmatch

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, tuple[bytes, bytes, int]] = {}
        self.stems: dict[str, list[int]] = {}
        self.marks: dict[str, list[int]] = {}

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        spans = np.array(self.tokenizer.encode(text, add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2)
        return spans[:, 0], spans[:, 1]

    def _stem(self, stem: str) -> list[int]:
        """Where the tokens of a word of ASCII letters end."""
        ends = self.stems.get(stem)
        if ends is None:
            if len(self.stems) > self.KEEP:
                self.stems.clear()
            ends = self.stems[stem] = list(accumulate(len(t.value) for t in self.tokenizer.model.tokenize(stem.replace(" ", "\u0120"))))
        return ends

    def _piece(self, piece: str) -> tuple[bytes, bytes, int]:
        plain = self._PLAIN(piece) if len(piece) <= self.LONG else None
        if plain:
            ends = self._stem(plain[1])
            if plain[2]:
                at, marks = len(plain[1]), self.marks.get(plain[2])
                if marks is None:
                    marks = self._whole(plain[2])[1].tolist()
                    if len(self.marks) < 10_000:
                        self.marks[plain[2]] = marks
                ends = ends + [at + e for e in marks]
            starts = [0, *ends[:-1]]
        else:
            starts, ends = (x.tolist() for x in self._whole(piece))
        return array("i", starts).tobytes(), array("i", ends).tobytes(), len(ends)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if self._UNUSUAL(text):
            return self._whole(text)
        known, found = self.known, []
        pieces = self._PIECES(text)
        for piece in pieces:
            x = known.get(piece)
            if x is None:
                x = self._piece(piece)
                if len(piece) <= self.LONG:
                    if len(known) > self.KEEP:
                        known.clear()
                    known[piece] = x
            found.append(x)
        begin = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))[: len(pieces)]
        at = np.repeat(begin, [n for _, _, n in found]) if found else np.zeros(0, np.int64)
        return at + np.frombuffer(b"".join([s for s, _, _ in found]), np.intc), at + np.frombuffer(b"".join([e for _, e, _ in found]), np.intc)


def encoder(path: str) -> SpanEncoder:
    """One encoder, with what it has looked up, for all tasks of a worker that follow each other."""
    return kept(("spans", path), lambda: SpanEncoder(path))


def count_tokens(docs: DataFrame, tokenizer: str, sections=line_sections) -> DataFrame:
    """Tokens of each section of each document: doc_id, section (from 0), start, end, n_tokens, n_shared.

    Each text is encoded once, whole, with the byte-level tokenizer at the given path; its token spans (code
    points) are joined to the sections' spans, both sorted, by binary search. sections(text) returns starts
    and ends, disjoint and sorted. Tokens that cross a boundary go by the rule of attribute(), and n_shared
    says how many a section got that way; so the sections' tokens add up to the document's wherever the
    sections cover it. Tokens that are parts of one character share its span. Strings of special tokens in
    a text count as ordinary text.

    Null and empty texts have no sections and so no rows. Repeated rows are counted each. An empty table
    gives an empty result. Other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = encoder(tokenizer).spans
        for batch in runs(batches):
            parts = []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = sections(text or "")
                if len(a):
                    parts.append((doc, a, b, *attribute(a, b, *spans(text))))
            if parts:
                docs = [d for d, a, *_ in parts for _ in range(len(a))]
                numbers = [pa.array(np.concatenate(c)) for c in zip(*(p[1:] for p in parts), strict=True)]
                places = pa.array(np.concatenate([np.arange(len(p[1]), dtype=np.int32) for p in parts]))
                yield pa.record_batch([pa.array(docs, pa.int64()), places, *numbers], [c.split()[0] for c in SCHEMA.split(", ")])

    return pick(docs, doc_id="doc_id", text="text").mapInArrow(count, SCHEMA)

