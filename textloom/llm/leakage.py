"""Evaluation texts leaking into training text.

Method: every window of ``words`` words is embedded by the CGK random walk, which maps edit distance to Hamming
distance; repeated samples of the embedding's positions are the keys of a locality-sensitive hash, in enough
repetitions for the target recall; windows that meet in a key are verified exactly. Windows that differ in no word
have one embedding, so with ``edits=0`` one repetition has a recall of 1 and the result is exact.

The items are a stated query set: their windows are broadcast in blocks of at most ``block_windows`` windows, so what
is sent has a fixed bound, and every document passes every block. Documents are scanned where they lie, without a
shuffle; only the distinct pairs of document and item are shuffled. A document's windows are embedded only if at most
``edits`` of their words are foreign to the block, since no other window can match.

A word is a run of letters or digits in lower case. Remarks in round or square brackets, also nested ones, are left
out of either text; a bracket without its partner is punctuation.

Defined results: null or empty texts and texts of fewer words have no case; null ids are reported as they are;
repeated rows give each pair once; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

_WORD = re.compile(r"[^\W_]+")
_REMARK = re.compile(r"\[[^\[\]()]*\]|\([^()\[\]]*\)")
_REMARK_MIXED = re.compile(r"\[[^\[\]]*\]|\([^()]*\)")


def words_of(text: str | None) -> list[str]:
    """The words of a text, without remarks in brackets."""
    if not text:
        return []
    if "(" in text or "[" in text:
        for pattern in (_REMARK, _REMARK_MIXED):
            n = 1
            while n:
                text, n = pattern.subn(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return _WORD.findall(text.lower())


class Index:
    """The windows of a block of items, hashed; everything in it is bounded by the block."""

    def __init__(self, items: list[tuple], words: int, edits: int, recall: float, seed: int):
        rng = np.random.default_rng(seed)
        self.words, self.edits = words, edits
        self.vocabulary: dict[str, int] = {}
        self.items = [i for i, _ in items]
        parts, owner = [], []
        for k, (_, tokens) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens], np.int32)
            if len(ids) >= words:
                parts.append(np.lib.stride_tricks.sliding_window_view(ids, words))
                owner.append(np.full(len(parts[-1]), k, np.int32))
        self.windows = np.concatenate(parts) if parts else np.zeros((0, words), np.int32)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int32)
        length = 3 * words
        size = max(4, length // (3 * edits)) if edits else length
        p = self._meeting_chance(rng, length, size) if edits else 1.0
        repeats = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        # every repetition has a walk of its own, so that they miss independently
        self.walks = [rng.integers(0, 2, (length, len(self.vocabulary) + 2), dtype=np.int8) for _ in range(repeats)]
        self.samples = [np.sort(rng.choice(length, size, replace=False)) if size < length else np.arange(length) for _ in range(repeats)]
        self.mix = rng.integers(1, 2**63, (repeats, length), dtype=np.uint64) | np.uint64(1)
        self.tables = []
        for keys in self.keys(self.windows):
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], order))

    def _meeting_chance(self, rng: np.random.Generator, length: int, size: int, trials: int = 400) -> float:
        """The chance that a window and one ``edits`` edits away agree in ``size`` places of their walks, by trial."""
        n, total = self.words, 0.0
        for _ in range(trials):
            a = list(range(1, n + 1))
            b = list(a)
            for e in range(self.edits):
                at, kind = int(rng.integers(0, n)), int(rng.integers(0, 3))
                if kind == 0:
                    b[at] = n + 1 + e
                elif kind == 1:
                    b.insert(at, n + 1 + e)
                else:
                    b.pop(min(at, len(b) - 1))
                    b.append(2 * n - e)
                b = b[:n]
            walk = rng.integers(0, 2, (length, 2 * n + 2), dtype=np.int8)
            x, y = (self._embed(np.array([w], np.int32), walk, 2 * n + 1)[0] for w in (a, b))
            total += float((x == y).mean()) ** size
        return max(1e-3, min(0.999, total / trials))

    def _embed(self, windows: np.ndarray, walk: np.ndarray, pad: int) -> np.ndarray:
        """The CGK walk: at each step the current word is put out and the walk moves on by that word's random bit."""
        n = self.words
        padded = np.concatenate([windows, np.full((len(windows), 1), pad, np.int32)], axis=1)
        at, rows = np.zeros(len(windows), np.intp), np.arange(len(windows))
        out = np.empty((len(windows), len(walk)), np.int32)
        for j, bits in enumerate(walk):
            out[:, j] = padded[rows, at]
            at = np.minimum(at + bits[out[:, j]], n)
        return out

    def keys(self, windows: np.ndarray) -> Iterator[np.ndarray]:
        for walk, sample, mix in zip(self.walks, self.samples, self.mix, strict=True):
            out = self._embed(windows, walk, len(self.vocabulary) + 1)[:, sample].astype(np.uint64) + np.uint64(1)
            with np.errstate(over="ignore"):
                h = (out * mix[sample]).sum(axis=1, dtype=np.uint64)
                yield h ^ (h >> np.uint64(29))

    def matches(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts in ``ids`` and items whose windows are within the edit distance; ids are 0 for foreign words."""
        n = self.words
        none = np.zeros(0, np.int64), np.zeros(0, np.int32)
        if len(ids) < n or not len(self.windows):
            return none
        sums = np.concatenate([[0], np.cumsum(ids > 0)])
        starts = np.flatnonzero(sums[n:] - sums[:-n] >= n - self.edits)
        if not len(starts):
            return none
        found_at, found = [], []
        for k in range(0, len(starts), 65536):
            own = starts[k : k + 65536]
            windows = np.lib.stride_tricks.sliding_window_view(ids, n)[own]
            for keys, (table, order) in zip(self.keys(windows), self.tables, strict=True):
                lo, hi = np.searchsorted(table, keys, "left"), np.searchsorted(table, keys, "right")
                count = hi - lo
                left = np.repeat(np.arange(len(own)), count)
                right = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
                ok = self.verify(windows[left], self.windows[right])
                found_at.append(own[left[ok]])
                found.append(self.owner[right[ok]])
        return np.concatenate(found_at), np.concatenate(found)

    def verify(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the windows of each pair are within the edit distance, by the full dynamic programme."""
        if not self.edits:
            return (a == b).all(axis=1)
        n = self.words
        row = np.tile(np.arange(n + 1), (len(a), 1))
        for i in range(1, n + 1):
            new = np.empty_like(row)
            new[:, 0] = i
            for j in range(1, n + 1):
                new[:, j] = np.minimum(np.minimum(row[:, j], new[:, j - 1]) + 1, row[:, j - 1] + (a[:, i - 1] != b[:, j - 1]))
            row = new
        return row[:, n] <= self.edits


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, words: int = 12, edits: int = 0, recall: float = 0.95, block_windows: int = 500_000, seed: int = 7) -> DataFrame:
    """Distinct ``doc_id, item_id`` of documents and items that have a window of ``words`` words in common.

    edits: the edit distance in words up to which two windows are held to be the same; recall: for edits above 0.
    """
    spark = docs.sparkSession
    schema = docs.select(F.col(doc_id).alias("doc_id")).schema.add("item_id", items.schema[item_id].dataType)
    item_type = to_arrow_type(items.schema[item_id].dataType)
    blocks: list[list[tuple]] = [[]]
    room = block_windows
    for row in items.select(item_id, item_text).distinct().toLocalIterator():
        tokens = words_of(row[1])
        # an item larger than a block is cut with an overlap of a window
        for k in range(0, max(1, len(tokens) - words + 1), block_windows):
            part = tokens[k : k + block_windows + words - 1]
            if len(part) > room:
                blocks.append([])
                room = block_windows
            blocks[-1].append((row[0], part))
            room -= len(part)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index: Index = shared.value
            get, gap = index.vocabulary.get, [0] * (edits + 1)
            for b in batches:
                ids: list[int] = []
                ends = []
                for t in b.column(1).to_pylist():
                    ids.extend([get(w, 0) for w in words_of(t)])
                    ids.extend(gap)
                    ends.append(len(ids))
                at, item = index.matches(np.array(ids, np.int32))
                pairs = np.unique(np.stack([np.searchsorted(ends, at, "right"), item]), axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pairs[0])), pa.array([index.items[i] for i in pairs[1]], item_type)], names=["doc_id", "item_id"])

        return run

    found = [rows.mapInArrow(scan(spark.sparkContext.broadcast(Index(b, words, edits, recall, seed))), schema) for b in blocks]
    return reduce(DataFrame.unionByName, found).distinct()
