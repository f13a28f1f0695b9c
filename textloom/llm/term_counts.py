"""Frequency of every distinct term: occurrences, records, and a mark for terms too rare or too common to be useful.

Method: pairs of term and record are range-partitioned and sorted externally; one scan over the runs of equal terms
counts occurrences and distinct records. The sort key ends in the record, so that a term that holds a third of all
rows is spread over many partitions; the few partial counts of such a term are added up at the end.

Defined results: null terms are no terms, null records count as no record and are left out; rows that agree in term,
record and place are one occurrence; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTIAL = "term string, field string, occurrences long, records long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a partition sorted by term, field, record and place: one row per run of equal terms and batch.

    A run that crosses batches gives several rows; the last record and place seen are carried over, so that nothing
    is counted twice.
    """
    last: tuple | None = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        cols = [b.column(i) for i in range(4)]
        now = tuple(c[0].as_py() for c in cols)
        new = [np.ones(n, bool) for _ in cols]
        for k, c in enumerate(cols):
            if n > 1:
                new[k][1:] = pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[k][0] = last is None or now[k] != last[k]
        term = new[0] | new[1]
        record = term | new[2]
        place = record | new[3]
        starts = np.flatnonzero(term | (np.arange(n) == 0))
        yield pa.RecordBatch.from_arrays(
            [cols[0].take(pa.array(starts)), cols[1].take(pa.array(starts)), pa.array(np.add.reduceat(place.astype(np.int64), starts)), pa.array(np.add.reduceat(record.astype(np.int64), starts))],
            names=["term", "field", "occurrences", "records"],
        )
        last = tuple(c[n - 1].as_py() for c in cols)


def term_counts(df: DataFrame, terms: dict[str, Column], record: str, place: str) -> DataFrame:
    """``field, term, occurrences, records`` of every distinct non-null term of each field.

    terms: string columns by field name. A row is one occurrence of its terms in ``record`` (long) at ``place`` (long).
    """
    long = df.select(F.col(record).cast("long").alias("record"), F.col(place).cast("long").alias("place"), F.explode(F.array(*(F.struct(F.lit(k).alias("field"), c.alias("term")) for k, c in terms.items()))).alias("t"))
    pairs = long.select("t.field", "t.term", "record", "place").where("term is not null and record is not null and place is not null")
    # the term goes before the field, so that the sort is settled by its first bytes for most rows
    placed = pairs.select("term", "field", "record", "place").repartitionByRange(F.col("term"), F.col("field"), F.col("record")).sortWithinPartitions("term", "field", "record", "place")
    return placed.mapInArrow(_runs, _PARTIAL).groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(counts: DataFrame, records: DataFrame, min_records: int = 3, max_share: float = 0.2) -> DataFrame:
    """``counts`` with ``mark``: ``rare`` below ``min_records`` records, ``common`` above ``max_share`` of all, else null.

    records: one row whose first column is the number of all records.
    """
    total = records.select(F.col(records.columns[0])).scalar()
    return counts.withColumn("mark", F.when(F.col("records") < min_records, "rare").when(F.col("records") > max_share * total, "common"))
