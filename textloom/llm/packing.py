"""Filling fixed-capacity containers with items.

Method: first-fit decreasing. The open containers' free room is held in a tournament tree, so that the first container
an item fits in is found in a logarithm of steps; items go in groups chosen at random by a hash, each packed by itself,
so a group's size is bounded and groups run in parallel. Only ids and sizes are shuffled, never texts.

The number of groups follows from the number of items (about ``group_items`` each), and every item takes part. A text
longer than the capacity is split into full containers of its own and a rest, which is packed like any other item.

Sizes are counted in tokens of a public tokenizer, whose file is a parameter; texts are tokenised where they lie.

Defined results: null and empty texts have size 0 and take a place in the first container of their group; equal sizes
are packed in the order of their ids; repeated rows are repeated items, told apart by ``copy``; a capacity below 1 or
null is no container; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = os.environ.get("TEXTLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Containers are a parameter table; more kinds than that are an error.
MAX_KINDS = 1000
#: Splits text into the pieces that byte pairs are merged within.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(docs: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, tokens`` of every row; a text's pieces are looked up in a cache of this task before they are merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import regex
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        pieces = regex.compile(PIECES).findall
        cache: dict[str, int] = {}
        for b in batches:
            counts = []
            for t in b.column(1).to_pylist():
                n = 0
                for p in pieces(t or ""):
                    c = cache.get(p)
                    if c is None:
                        c = len(encoding.encode_ordinary(p))
                        if len(cache) < 500_000 and len(p) < 64:
                            cache[p] = c
                    n += c
                counts.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=["doc_id", "tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, rows.select("doc_id").schema.add("tokens", T.LongType()))


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, for sizes in decreasing order and none above the capacity.

    The tree's leaves are bins with their free room, each inner node has the larger room of its two children; the first
    bin with room is found from the root by going left wherever the left child has room.
    """
    n = len(sizes)
    leaves = 1
    while leaves < max(1, n):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    out = np.empty(n, np.int64)
    for i, s in enumerate(sizes.tolist()):
        k = 1
        while k < leaves:
            k *= 2
            if tree[k] < s:
                k += 1
        out[i] = k - leaves
        tree[k] -= s
        k //= 2
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            room = a if a > b else b
            if tree[k] == room:
                break
            tree[k] = room
            k //= 2
    return out


def pack(items: DataFrame, containers: DataFrame, group_items: int = 20_000, seed: int = 11, n_items: int | None = None) -> DataFrame:
    """``container_kind, container_id, doc_id, copy, part, tokens``: the container of every item or part of an item.

    items: ``doc_id, tokens``; containers: ``container_kind, capacity_tokens``, a table of at most ``MAX_KINDS`` rows.
    n_items: the number of items where the caller knows it, else they are counted. Equal rows are numbered by ``copy``
    before they are grouped, so that many copies of one document spread over the groups.
    """
    groups = max(1, -(-(items.count() if n_items is None else n_items) // group_items))
    kinds = containers.where("capacity_tokens >= 1").select("container_kind", F.col("capacity_tokens").cast("long").alias("capacity")).distinct().limit(MAX_KINDS + 1).collect()
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers")
    id_type = items.schema["doc_id"].dataType.simpleString()
    fields = f"container_kind string, container_id string, doc_id {id_type}, copy int, part int, tokens long"
    sized = items.groupBy("doc_id", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")).agg(F.count("*").alias("_n"))
    # copies are numbered through all rows of an id, also where their sizes differ
    ids = Window.partitionBy("doc_id").orderBy("tokens").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("_first", F.coalesce(F.sum("_n").over(ids), F.lit(0)))
    chunk = 10_000
    chunks = sized.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(chunk).cast("long"))))
    copies = chunks.withColumn("copy", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + chunk, F.col("_n")) - 1)))
    grouped = copies.select("doc_id", (F.col("copy") + F.col("_first")).cast("int").alias("copy"), "tokens", F.pmod(F.xxhash64("doc_id", "tokens", "copy", F.lit(seed)), F.lit(groups)).alias("_group"))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind, group, capacity = key
        pdf = pdf.sort_values(["tokens", "doc_id", "copy"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        full = (pdf["tokens"] // capacity).where(pdf["tokens"] > capacity, 0)
        rest = pdf["tokens"] - full * capacity
        whole = pdf.loc[pdf.index.repeat(full)]
        part = whole.groupby(level=0).cumcount()
        left = pdf[(rest > 0) | (full == 0)].assign(size=rest, part=full)
        left = left.sort_values(["size", "doc_id", "copy"], ascending=[False, True, True], kind="stable")
        bins = first_fit_decreasing(left["size"].to_numpy(np.int64), int(capacity))
        first = int(bins.max()) + 1 if len(bins) else 0
        out = pd.concat(
            [
                pd.DataFrame({"bin": bins, "doc_id": left["doc_id"], "copy": left["copy"], "part": left["part"], "tokens": left["size"]}),
                pd.DataFrame({"bin": first + np.arange(len(whole)), "doc_id": whole["doc_id"], "copy": whole["copy"], "part": part, "tokens": capacity}),
            ]
        )
        out["container_kind"] = kind
        out["container_id"] = [f"{kind}-{group}-{b}" for b in out["bin"]]
        return out[["container_kind", "container_id", "doc_id", "copy", "part", "tokens"]]

    # every container kind packs all items
    options = F.array(*(F.struct(F.lit(r["container_kind"]).cast("string").alias("container_kind"), F.lit(r["capacity"]).cast("long").alias("capacity")) for r in kinds)) if kinds else F.expr("cast(array() as array<struct<container_kind: string, capacity: long>>)")
    each = grouped.withColumn("_kind", F.explode(options)).select("_kind.container_kind", "_kind.capacity", "doc_id", "copy", "tokens", "_group")
    return each.groupBy("container_kind", "_group", "capacity").applyInPandas(fill, fields)
