"""References to records that do not exist.

Method: a Bloom filter of the parent keys is broadcast. A reference that the filter rejects certainly has no parent
and is ``missing``; it takes part in no join. References that the filter lets pass are verified by an exact join with
the spans of life of the parent's loads, then all are counted.

The filter is sized by the number of distinct parents, which is estimated first, and by ``false_positives``, up to
``MAX_FILTER_BYTES``; with more parents than that holds it lets more references pass to the exact join and the result
stays the same. Parents are one row per key with an array of their
spans (the loads of one key, few by nature). They are broadcast if they are few, which is counted, else references
are salted and the parents repeated once per salt, so that a key a third of all rows refer to is spread out.

Defined results: null and 0 are no references; at a null time no parent is alive, so the reason is ``missing`` or
``late``; references that agree in all columns are one; without parents every reference is missing; an empty table
gives an empty result; columns other than those named are passed through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.session import broadcast_if_small

SALTS = 16
#: The largest filter that is broadcast; it holds some 56 million keys at one percent of false positives.
MAX_FILTER_BYTES = 64 << 20


def filter_spots(keys: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """The filter's positions of each key: two mixed 64-bit hashes, combined once per hash function."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        one, two = x ^ (x >> np.uint64(31)), (x >> np.uint64(17)) | np.uint64(1)
        return np.stack([(one + np.uint64(i) * two) % np.uint64(bits) for i in range(hashes)])


def bloom_filter(keys: DataFrame, key: str, expected: int | None = None, false_positives: float = 0.01) -> tuple[np.ndarray, int]:
    """The filter of the whole column as bytes, and the number of its hash functions.

    expected: the number of distinct keys where it is known, else it is estimated. Every task fills a filter of its own
    and passes on the words that are not zero; they are merged by ``bit_or`` on the executors. What comes to the driver
    is the filter: 1.2 bytes a key at one percent, at most ``MAX_FILTER_BYTES``.
    """
    if expected is None:
        expected = int(keys.agg(F.approx_count_distinct(key, 0.02)).first()[0] * 1.05)
    expected = max(1000, expected)
    bits = (min(int(-expected * math.log(false_positives) / math.log(2) ** 2), MAX_FILTER_BYTES * 8) // 64 + 1) * 64
    hashes = max(1, round(bits / expected * math.log(2)))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for b in batches:
            spots = filter_spots(b.column(0).to_numpy(zero_copy_only=False), bits, hashes).ravel()
            np.bitwise_or.at(own, spots >> np.uint64(3), np.uint8(1) << (spots & np.uint64(7)).astype(np.uint8))
        words = own.view(np.int64)
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(words[some])], names=["word", "bits"])

    words = keys.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k")).mapInArrow(fill, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint8), hashes


def find_orphans(refs: DataFrame, parents: DataFrame, expected: int | None = None) -> DataFrame:
    """The distinct references that name no parent alive at their time: the columns of ``refs`` and ``reason``.

    refs: ``target_id``, ``ref_time`` and any further columns. parents: ``key``, ``loaded_at``, ``deleted_at``.
    ``reason`` is ``missing`` if no parent has the key, ``deleted`` if one was loaded by then, else ``late``.
    """
    names = [c for c in refs.columns if c != "reason"]
    refs = refs.select(names).withColumn("target_id", F.col("target_id").cast("long")).where("target_id <> 0")
    parents = parents.where("key is not null").select(F.col("key").cast("long").alias("_key"), "loaded_at", "deleted_at")
    spark = refs.sparkSession
    filled, hashes = bloom_filter(parents, "_key", expected)
    shared = spark.sparkContext.broadcast(filled)

    def might_exist(ids: pd.Series) -> pd.Series:
        own = shared.value
        spots = filter_spots(ids.to_numpy(np.int64), len(own) * 8, hashes)
        return pd.Series(((own[spots >> np.uint64(3)] >> (spots & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0))

    tested = refs.withColumn("_hit", F.pandas_udf(might_exist, T.BooleanType())("target_id"))
    spans = parents.groupBy("_key").agg(F.collect_set(F.struct("loaded_at", "deleted_at")).alias("_spans"))
    small = broadcast_if_small(parents)
    if small is not parents:
        joined = tested.join(F.broadcast(spans), F.when(F.col("_hit"), F.col("target_id")) == F.col("_key"), "left")
    else:
        salted = tested.withColumn("_salt", F.pmod(F.xxhash64(*names), F.lit(SALTS)).cast("int"))
        spread = spans.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        verified = salted.where("_hit").join(spread, (F.col("target_id") == F.col("_key")) & (salted["_salt"] == spread["_salt"]), "left").select(*names, "_key", "_spans")
        joined = verified.unionByName(salted.where("not _hit").select(*names), allowMissingColumns=True)
    t = F.col("ref_time")
    alive = F.exists("_spans", lambda s: (s["loaded_at"] <= t) & (s["deleted_at"].isNull() | (s["deleted_at"] > t)))
    loaded = F.exists("_spans", lambda s: s["loaded_at"] <= t)
    reason = F.when(F.col("_key").isNull(), "missing").when(F.coalesce(loaded, F.lit(False)), "deleted").otherwise("late")
    return joined.where(F.col("_key").isNull() | ~F.coalesce(alive, F.lit(False))).select(*names, reason.alias("reason")).distinct()
