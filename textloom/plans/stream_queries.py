"""Streams run to their present end, checked against the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans.base import LEX, SENSE, lexicon, words_sql
from textloom.streaming import messages as M

WINDOW_S, LATE_S = 30 * 86400, 7 * 86400


def stream_once(spark: SparkSession, d: str) -> DataFrame:
    """Messages delivered twice, each once."""
    return M.run_once(M.once(M.message_stream(spark, d)).select("input_id", "session_id", "received_at")).withColumn("received_at", F.col("received_at").cast("timestamp_ntz"))


def stream_tag_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tags per window of 30 days, of windows that are over."""
    words = M.stream_words(M.once(M.message_stream(spark, d), late=f"{LATE_S} seconds"), lexicon(spark, d))
    counts = M.run_once(M.tag_counts(words, f"{WINDOW_S} seconds"))
    return counts.select(F.col("window.start").cast("long").alias("window_start"), "tag", "tokens")


_COUNTS = f"""WITH m AS (SELECT DISTINCT input_id, received_at, original FROM tokenized_input), {words_sql('SELECT input_id, received_at, original FROM m', 'input_id, received_at', 'original')}, {LEX}, {SENSE}
SELECT CAST(floor(epoch(received_at) / {WINDOW_S}) * {WINDOW_S} AS BIGINT) AS window_start, coalesce(s.pos, 'FW') AS tag, count(*) AS tokens FROM words w LEFT JOIN sense s ON lower(w.word) = s.word
WHERE floor(epoch(received_at) / {WINDOW_S}) * {WINDOW_S} + {WINDOW_S} <= (SELECT max(epoch(received_at)) FROM tokenized_input) - {LATE_S} GROUP BY 1, 2"""


def queries() -> dict:
    return {f.__name__: f for f in (stream_once, stream_tag_counts)}


def oracle_sql() -> dict[str, str]:
    return {"stream_once": "SELECT DISTINCT input_id, session_id, received_at FROM tokenized_input", "stream_tag_counts": _COUNTS}
