"""Feature scores learnt from the tokens that they resolve: the same as ``context.resolve_by_features`` with
``context.model_rows`` of the same tokens, without a row for each feature.

All that is learnt of a word comes from the places of that word, so tokens of words with several senses are sent to their
word, once, each with its neighbours as numbers. There its features are counted and its tokens resolved, some words at a
time. A word with very many tokens is kept in a file meanwhile; what is held is the counts of its features.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.affixes import ADVERBS, AUXILIARIES, MODALS, PASSIVES, PERFECTS, PREFIXES_BY_LENGTH, SUFFIXES, TEMPORALS
from textloom.functions.predicates import TAGS, short_tag
from textloom.operators.context import AFTER, BEFORE, BLEND, STEP_AFTER, STEP_BEFORE, WEIGHTS, features, model_rows, resolve_by_features, tag_frequency, windows
from textloom.session import dimension_join, ensure_checkpoint_dir

#: Rows handled at a time, and rows of a word beyond which they are kept in a file.
BLOCK, HELD = 100_000, 400_000
OFFSETS = [*range(-BEFORE, 0), *range(1, AFTER + 1)]
#: By name, so that of equal scores the first wins; a tag's code is its place, from 1.
_TAGS = sorted(TAGS)
_GROUP = {w: i for i, ws in reversed([*enumerate((MODALS, PASSIVES, AUXILIARIES, PERFECTS, TEMPORALS, ADVERBS), 1)]) for w in ws}
#: Features of a word by their places in one number.
_PRONOUN = ("category", "person", "number")
_BITS = {"suffix": (0, 8), "prefix": (8, 8), "word_group": (16, 4), **{f"pronoun_{k}": (20 + 12 * i, 12) for i, k in enumerate(_PRONOUN)}}
_KINDS = ("tag", "word", "tag_group", *_BITS)


def _weight(kind: str, offset: int) -> float:
    near = 1 + STEP_BEFORE * (BEFORE + offset) if offset < 0 else 1 + STEP_AFTER * (AFTER - offset)
    return round(WEIGHTS[kind] * near, 4)


def _word_number(word: str | None) -> int:
    if word is None:
        return 0
    suffix = next((i for i, s in enumerate(SUFFIXES, 1) if word.endswith(s)), 0)
    prefix = next((i for i, p in enumerate(PREFIXES_BY_LENGTH, 1) if word.startswith(p)), 0)
    return suffix | prefix << 8 | _GROUP.get(word, 0) << 16


def _bytes(x: np.ndarray) -> pa.Array:
    """A binary value for each row."""
    x = np.ascontiguousarray(x)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * (x.itemsize * x.shape[1])), pa.py_buffer(x)])


def _numbers(column: pa.Array, kind: type) -> np.ndarray:
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind).reshape(-1, len(OFFSETS))


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def _placed(values: dict[str, list[str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Inputs, each in order, to their tokens with several senses and the numbers of their neighbours."""
    tags = pa.array(_TAGS)
    sets = {k: pa.array(v, pa.string()) for k, v in values.items()}

    def code(column: pa.Array, among: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.add(pc.index_in(column, among), 1), 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, int] = {}

        def of(b: pa.RecordBatch) -> pa.RecordBatch:
            words = b["w"].dictionary_encode()
            numbers = []
            for w in words.dictionary.to_pylist():
                if (k := known.get(w)) is None:
                    k = known[w] = _word_number(w)
                numbers.append(k)
            own = np.array([*numbers, 0], np.int64)[pc.fill_null(words.indices, len(numbers)).to_numpy(zero_copy_only=False)]
            for k in _PRONOUN:
                own |= code(b[k], sets[k]) << _BITS[f"pronoun_{k}"][0]
            h, t = b["h"].to_numpy(zero_copy_only=False), code(b["t"], tags).astype(np.uint8)
            seq, sent = (b[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("seq", "sent"))
            group = np.cumsum((b["n"].to_numpy(zero_copy_only=False) == 1) | (sent != np.concatenate([sent[:1] - 1, sent[:-1]])))
            at = np.flatnonzero(pc.fill_null(b["a"], False).to_numpy(zero_copy_only=False))
            H, D, T = (np.zeros((len(at), len(OFFSETS)), x) for x in (np.int64, np.int64, np.uint8))
            for r in OFFSETS:  # rows away; a neighbour is placed by the distance of its number
                i = at + r
                ok = (i >= 0) & (i < len(seq))
                i = np.clip(i, 0, len(seq) - 1)
                far = seq[i] - seq[at]
                ok &= (group[i] == group[at]) & (far >= -BEFORE) & (far <= AFTER)
                rows, i, far = np.flatnonzero(ok), i[ok], far[ok]
                slot = far + BEFORE - (far > 0)
                H[rows, slot], D[rows, slot], T[rows, slot] = h[i], own[i], t[i]
            x = pa.array(at)
            return pa.RecordBatch.from_arrays([b["input_id"].take(x), b["seq"].take(x), b["w"].take(x), pa.array(t[at].astype(np.int8)), _bytes(H), _bytes(D), _bytes(T)], names=["input_id", "seq", "w", "t", "words", "numbers", "tags"])

        kept: list[pa.RecordBatch] = []
        for b in batches:
            begins = np.flatnonzero(b["n"].to_numpy(zero_copy_only=False) == 1)
            if len(begins) and sum(x.num_rows for x in kept) + begins[-1] >= BLOCK:
                yield of(_one([*kept, b.slice(0, begins[-1])]))
                kept = [b.slice(begins[-1])]
            else:
                kept.append(b)
        if kept:
            yield of(_one(kept))

    return run


class _Kept:
    """Batches that are read several times, in pieces of some ``block`` rows; beyond ``held`` rows they are in a file."""

    def __init__(self, block: int, held: int) -> None:
        self.block, self.held = block, held
        self.rows, self.batches, self.file, self.writer = 0, [], None, None

    def add(self, b: pa.RecordBatch) -> None:
        self.rows += b.num_rows
        self.batches.append(b)
        if self.file is None and self.rows > self.held:
            self.file = tempfile.TemporaryFile()
            self.writer = pa.ipc.new_stream(self.file, b.schema)
        if self.file is not None:
            for x in self.batches:
                self.writer.write_batch(x)
            self.batches = []

    def done(self) -> _Kept:
        if self.writer:
            self.writer.close()
        return self

    def pieces(self) -> Iterator[pa.RecordBatch]:
        if self.file is not None:
            self.file.seek(0)
        some: list[pa.RecordBatch] = []
        for b in self.batches if self.file is None else pa.ipc.open_stream(self.file):
            some.append(b)
            if sum(x.num_rows for x in some) >= self.block:
                yield _one(some)
                some = []
        if some:
            yield _one(some)


class _Counts:
    """How often each key was seen with each of its word's tags."""

    def __init__(self, width: int) -> None:
        self.width, self.parts = width, []

    def add(self, keys: np.ndarray, tag: np.ndarray) -> None:
        names, i = np.unique(keys, return_inverse=True)
        self.parts.append((names, np.bincount(i * self.width + tag, minlength=len(names) * self.width).reshape(-1, self.width)))
        if len(self.parts) > 8:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            names, i = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
            total = np.zeros((len(names), self.width), np.int64)
            np.add.at(total, i, np.concatenate([n for _, n in self.parts]))
            self.parts = [(names, total)]

    def shares(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        names, n = self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros((0, self.width)))
        return names, n / n.sum(axis=1, keepdims=True)


def _settled(groups: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tokens by their word, all of a word one behind the other, to their tags. groups: the group of each tag's code."""
    group_of = np.array([groups.get(i, 0) for i in range(len(_TAGS) + 1)], np.int64)

    def places(b: pa.RecordBatch, word: np.ndarray) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
        """For each offset and kind the rows that have such a feature, and its keys."""
        H, D, T = _numbers(b["words"], np.int64), _numbers(b["numbers"], np.int64), _numbers(b["tags"], np.uint8)
        spread = (word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        for j in range(len(OFFSETS)):
            there = np.flatnonzero(T[:, j])
            tag, numbers, base = T[there, j].astype(np.int64), D[there, j], word[there] << 12
            for kind in _KINDS:
                if kind == "word":
                    ok = H[there, j] != 0
                    yield j, kind, there[ok], H[there[ok], j] ^ spread[there[ok]]
                    continue
                value = tag if kind == "tag" else group_of[tag] if kind == "tag_group" else numbers >> _BITS[kind][0] & (1 << _BITS[kind][1]) - 1
                ok = value > 0
                yield j, kind, there[ok], base[ok] | value[ok]

    def of(kept: _Kept) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}

        def word_of(b: pa.RecordBatch) -> np.ndarray:
            w = b["w"].dictionary_encode()
            return np.array([codes.setdefault(x, len(codes)) for x in w.dictionary.to_pylist()], np.int64)[w.indices.to_numpy(zero_copy_only=False)]

        # the tags of every word, in order, and how often it has them
        pairs, often = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in kept.pieces():
            p, n = np.unique(word_of(b) * 64 + b["t"].to_numpy(zero_copy_only=False), return_counts=True)
            pairs, i = np.unique(np.concatenate([pairs, p]), return_inverse=True)
            often = np.bincount(i, np.concatenate([often, n])).astype(np.int64)
        owner = pairs >> 6
        rank = np.arange(len(pairs)) - np.searchsorted(owner, owner)
        width = int(rank.max()) + 1
        tags, freq = np.zeros((len(codes), width), np.int64), np.zeros((len(codes), width))
        tags[owner, rank], freq[owner, rank] = pairs & 63, often
        freq /= freq.sum(axis=1, keepdims=True)
        counts = {(j, k): _Counts(width) for j in range(len(OFFSETS)) for k in _KINDS}
        for b in kept.pieces():
            word = word_of(b)
            tag = rank[np.searchsorted(pairs, word * 64 + b["t"].to_numpy(zero_copy_only=False))]
            for j, kind, rows, keys in places(b, word):
                counts[j, kind].add(keys, tag[rows])
        shares = {k: c.shares() for k, c in counts.items()}
        for b in kept.pieces():
            word = word_of(b)
            total = np.zeros((len(word), width))
            for j, kind, rows, keys in places(b, word):
                names, share = shares[j, kind]
                p = share[np.searchsorted(names, keys)] * _weight(kind, OFFSETS[j])
                if kind == "tag":
                    best = np.zeros_like(total)
                    best[rows] = p
                elif kind == "word":
                    best[rows] = np.maximum(best[rows], p)
                    total += best
                else:
                    total[rows] += p
            score = np.floor((BLEND[0] * total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300) + BLEND[1] * freq[word]) * 1e6 + 0.5) / 1e6
            score[total <= 0] = -1.0
            k = score.argmax(axis=1)
            ok = np.flatnonzero(score[np.arange(len(word)), k] >= 0)
            names = np.array([None, *_TAGS], object)[tags[word[ok], k[ok]]]
            yield pa.RecordBatch.from_arrays([*(b[c].take(pa.array(ok)) for c in ("input_id", "seq", "w")), pa.array(names, pa.string()), pa.array(score[ok, k[ok]])], names=["input_id", "seq", "w", "tag", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, last = _Kept(BLOCK, HELD), None
        for b in batches:
            if not b.num_rows:
                continue
            if kept.rows >= BLOCK:
                other = np.flatnonzero(pc.not_equal(b["w"], last).to_numpy(zero_copy_only=False))
                if len(other):
                    if other[0]:
                        kept.add(b.slice(0, other[0]))
                    yield from of(kept.done())
                    kept, b = _Kept(BLOCK, HELD), b.slice(other[0])
            kept.add(b)
            last = b["w"][-1]
        if kept.rows:
            yield from of(kept.done())

    return run


def resolve(sents: DataFrame, words: DataFrame, pronouns: DataFrame) -> DataFrame:
    """``input_id, seq, w, tag, score`` of the tokens of ``words`` (column ``word``), by the features of their neighbours and
    the scores learnt from these tokens; see ``context.resolve_by_features``.

    pronouns: ``word, category, person, number``. Distances are those of ``seq``. Sent to the driver are the different
    values of the three; where they are more than an enumeration can be, features stay rows.
    """
    ensure_checkpoint_dir(sents.sparkSession)
    given = words.select("word").distinct().checkpoint()
    words = given.select(F.col("word").alias("_x"), F.lit(True).alias("a"))
    pronouns = pronouns.select(F.col("word").alias("_p"), *_PRONOUN).checkpoint()
    values = pronouns.agg(*(F.array_sort(F.collect_set(k)).alias(k) for k in _PRONOUN)).first().asDict()
    if any(len(v) >= 1 << 12 for v in values.values()):
        p = pronouns.withColumnRenamed("_p", "word")
        return resolve_by_features(windows(sents, given, p), model_rows(features(sents, given, p), tag_frequency(sents, given)))
    marked = dimension_join(dimension_join(sents, words, F.col("w") == F.col("_x")), pronouns, F.col("w") == F.col("_p"))
    h = F.when(F.col("w").isNotNull(), F.xxhash64("w")).otherwise(F.lit(0))
    # the number of the row has every input in one place and in order
    ordered = marked.select("input_id", "seq", "sent", "w", "t", "a", *_PRONOUN, h.alias("h"), F.row_number().over(Window.partitionBy("input_id").orderBy("seq")).alias("n"))
    key = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sents.select("input_id", "seq", "w").schema.fields)
    placed = ordered.mapInArrow(_placed(values), f"{key}, t tinyint, words binary, numbers binary, tags binary")
    short = sents.sparkSession.createDataFrame([(t,) for t in _TAGS], "t string").select("t", short_tag(F.col("t")).alias("s")).collect()
    names = sorted({r.s for r in short})
    groups = {_TAGS.index(r.t) + 1: names.index(r.s) + 1 for r in short}
    return placed.repartition("w").sortWithinPartitions("w").mapInArrow(_settled(groups), f"{key}, tag string, score double")
