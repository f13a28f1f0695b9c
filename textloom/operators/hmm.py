"""A hidden Markov model of tags: trained by counting, decoded by the best path through each sentence.

Training is one pass: neighbours and words with their tags are counted together, and initial, transition and emission
scores are all taken from that small table, which can be saved and loaded. For decoding, the scores of a word's
candidate tags are found once per distinct word and joined to the tokens; a sentence, bounded by its length, is gathered
and all sentences of an Arrow batch are walked together, place by place, with arrays over tag codes. Sent along are the
scores between tags, at most the square of the tag set, since tags outside of it count as FW.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import predicates as P
from textloom.session import dimension_join, ensure_checkpoint_dir, shuffled

#: Tags an unknown word may have.
OPEN_CLASS = ("NN", "NNS", "NNP", "VB", "VBD", "VBG", "VBN", "VBZ", "JJ", "RB")
SMOOTHING = 0.001
#: Digits kept of every score, so that engines agree; the score of what was never seen.
DIGITS = 9
NEVER = -30.0


def sentences(tokens: DataFrame) -> DataFrame:
    """Tokens ``input_id, seq, word, pos`` with ``sent``, the number of sentence stoppers before them, and tag ``t``."""
    before = Window.partitionBy("input_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    t = tokens.select("input_id", "seq", F.lower("word").alias("w"), P.known_tag(F.col("pos")).alias("t"))
    return t.withColumn("sent", F.coalesce(F.sum(F.when(P.is_sentence_stopper(F.col("t")), 1).otherwise(0)).over(before), F.lit(0)))


def _log(share: Column) -> Column:
    return F.round(F.log(share), DIGITS)


@dataclass
class Model:
    """Counts ``kind, a, b, n``: emissions of words by tags, transitions between tags, and tags that begin a sentence."""

    counts: DataFrame

    def _of(self, kind: str, a: str, b: str) -> DataFrame:
        return self.counts.where(F.col("kind") == kind).select(F.col("a").alias(a), F.col("b").alias(b), "n")

    def _vocabulary(self) -> Column:
        return self._of("emission", "tag", "word").agg(F.countDistinct("word")).scalar()

    def _per_tag(self) -> DataFrame:
        return F.broadcast(self._of("emission", "tag", "word").groupBy("tag").agg(F.sum("n").alias("total")))  # as many rows as tags

    def initial(self) -> DataFrame:
        """``tag, lp``: log share of each tag among the first of a sentence."""
        own = self._of("initial", "_", "tag")
        return own.select("tag", _log(F.col("n") / own.agg(F.sum("n")).scalar()).alias("lp"))

    def transitions(self) -> DataFrame:
        """``prev_tag, tag, lp``."""
        return self._of("transition", "prev_tag", "tag").select("prev_tag", "tag", _log(F.col("n") / F.sum("n").over(Window.partitionBy("prev_tag"))).alias("lp"))

    def emissions(self) -> DataFrame:
        """``tag, word, lp``, smoothed by the number of words."""
        return self._of("emission", "tag", "word").join(self._per_tag(), "tag").select("tag", "word", _log((F.col("n") + SMOOTHING) / (F.col("total") + SMOOTHING * self._vocabulary())).alias("lp"))

    def unseen(self) -> DataFrame:
        """``tag, lp``: the emission score of a word never seen with the tag."""
        return self._per_tag().select("tag", _log(SMOOTHING / (F.col("total") + SMOOTHING * self._vocabulary())).alias("lp"))

    def written(self) -> Model:
        """The model with its counts written once to the shared folder."""
        ensure_checkpoint_dir(self.counts.sparkSession)
        return Model(self.counts.checkpoint())

    def save(self, path: str) -> None:
        self.counts.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        return Model(spark.read.parquet(path))


def train(sents: DataFrame) -> Model:
    """Counts of all that the model needs, by one aggregation."""
    w = Window.partitionBy("input_id", "sent").orderBy("seq")
    seen = sents.select("w", "t", F.lag("t").over(w).alias("p"))
    first = F.col("p").isNull()
    each = F.array(
        F.struct(F.lit("emission").alias("kind"), F.col("t").alias("a"), F.col("w").alias("b")),
        F.struct(F.when(first, "initial").otherwise("transition").alias("kind"), F.when(first, "").otherwise(F.col("p")).alias("a"), F.col("t").alias("b")),
    )
    return Model(seen.select(F.explode(each).alias("c")).groupBy("c.kind", "c.a", "c.b").agg(F.count("*").alias("n")))


def word_scores(model: Model, senses: DataFrame, tags: DataFrame) -> DataFrame:
    """``word, cands``: the tags each word of the dictionary or the model may have, by code, with their emission scores.

    FW counts only where a word has no other tag; words that only the model knows may have the open-class tags.
    """
    codes = F.broadcast(tags.select("tag", "code"))  # the tag set
    known = senses.select("word", F.col("pos").alias("tag")).join(codes, "tag").distinct()
    other = known.where("tag <> 'FW'").select("word").distinct()
    own = known.where("tag <> 'FW'").unionByName(known.where("tag = 'FW'").join(shuffled(other), "word", "left_anti"))
    emitted = model.emissions()
    rest = emitted.select("word").distinct().join(shuffled(own.select("word").distinct()), "word", "left_anti")
    open_ = rest.withColumn("tag", F.explode(F.array(*map(F.lit, OPEN_CLASS)))).join(codes, "tag")
    scored = own.unionByName(open_.select(own.columns)).join(shuffled(emitted.withColumnRenamed("lp", "_e")), ["tag", "word"], "left").join(F.broadcast(model.unseen().withColumnRenamed("lp", "_m")), "tag", "left")
    return scored.groupBy("word").agg(F.array_sort(F.collect_list(F.struct(F.col("code").cast("int").alias("code"), F.coalesce("_e", "_m", F.lit(NEVER)).alias("e")))).alias("cands"))


def _paths(tokens: pa.ListArray, first: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentence, place, tag code and confidence of every token; all sentences are walked together, the longest first."""
    off = tokens.offsets.to_numpy()
    cands = tokens.values.field("cands")
    seq, coff = tokens.values.field("seq").to_numpy(), cands.offsets.to_numpy()
    code, e = cands.values.field("code").to_numpy(), cands.values.field("e").to_numpy()
    many = np.diff(coff)
    n, width = len(many), int(many.max(initial=1))
    at = np.arange(width)[None, :] < many[:, None]
    codes, scores = np.zeros((n, width), np.int64), np.full((n, width), -np.inf)
    codes[at], scores[at] = code[coff[0] : coff[-1]], e[coff[0] : coff[-1]]
    lengths = np.diff(off)
    order = np.argsort(-lengths, kind="stable")
    start, lengths = off[:-1][order], lengths[order]
    back = np.zeros((n, width), np.int16)
    sure, last = np.ones(n), np.zeros(len(order), np.int64)
    now = np.zeros((0, width))
    longest = int(lengths.max(initial=0))
    alive = np.searchsorted(-lengths, -np.arange(1, longest + 1), "right")  # sentences that reach so far
    for i in range(longest):
        k = alive[i]
        rows = start[:k] + i
        if not i:
            now = first[codes[rows]] + scores[rows]
        else:
            v = now[:k, :, None] + steps[codes[rows - 1][:, :, None], codes[rows][:, None, :]] + scores[rows][:, None, :]
            back[rows], now = v.argmax(axis=1), v.max(axis=1)
        top = now.max(axis=1, keepdims=True)
        sure[rows] = np.where(many[rows] < 2, 1.0, 1.0 / np.exp(now - top).sum(axis=1))
        ends = slice(alive[i + 1] if i + 1 < longest else 0, k)
        last[ends] = now[ends].argmax(axis=1)
    out = np.zeros(n, np.int64)
    for i in range(longest - 1, -1, -1):
        rows = start[: alive[i]] + i
        state = last[: alive[i]]
        out[rows] = codes[rows, state]
        last[: alive[i]] = back[rows, state]
    return np.repeat(np.arange(len(order)), np.diff(off)), seq[off[0] : off[-1]], out[off[0] : off[-1]], sure[off[0] : off[-1]]


def decode(sents: DataFrame, model: Model, senses: DataFrame, tags: DataFrame) -> DataFrame:
    """``input_id, seq, tag, confidence`` of the best path; of equal scores the lower tag code wins.

    confidence is the softmax of the candidates' scores at the token, of the largest; 1 for a single candidate.
    """
    spark = sents.sparkSession
    model = model.written()
    named = {r["tag"]: r["code"] for r in tags.select("tag", "code").collect()}  # the tag set
    size = max(named.values(), default=0) + 1
    first, steps = np.full(size, NEVER), np.full((size, size), NEVER)
    for r in model.initial().collect():
        first[named[r["tag"]]] = r["lp"]
    for r in model.transitions().collect():  # at most the square of the tag set
        steps[named[r["prev_tag"]], named[r["tag"]]] = r["lp"]
    missing = {r["tag"]: r["lp"] for r in model.unseen().collect()}
    default = F.array(*(F.struct(F.lit(named[t]).alias("code"), F.lit(missing.get(t, NEVER)).alias("e")) for t in sorted((t for t in OPEN_CLASS if t in named), key=named.get)))
    words = word_scores(model, senses, tags).withColumnRenamed("word", "_w").checkpoint()
    joined = dimension_join(sents.select("input_id", "sent", "seq", "w"), words, F.col("w") == F.col("_w")).select("input_id", "sent", "seq", F.coalesce("cands", default).alias("cands"))
    sequences = joined.groupBy("input_id", "sent").agg(F.array_sort(F.collect_list(F.struct("seq", "cands"))).alias("tokens")).select("input_id", "tokens")
    shared = spark.sparkContext.broadcast((first, steps, {c: t for t, c in named.items()}))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, steps, names = shared.value
        table = np.array([names.get(i, "FW") for i in range(len(first))], object)
        for b in batches:
            row, seq, code, sure = _paths(b.column(1), first, steps)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(seq, pa.int32()), pa.array(table[code], pa.string()), pa.array(sure)], names=["input_id", "seq", "tag", "confidence"])

    return sequences.mapInArrow(walk, f"input_id {sents.schema['input_id'].dataType.simpleString()}, seq int, tag string, confidence double")
