"""Messages as a stream: cleaning and look-ups row by row, windowed tag counts with late data, deliveries made twice."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.lexicon import Lexicon
from textloom.operators import cleaning
from textloom.session import broadcast_if_small, ensure_checkpoint_dir
from textloom.sources import table_path


def message_stream(spark: SparkSession, base: str, table: str = "tokenized_input", files_per_batch: int | None = None) -> DataFrame:
    """A table's folder as a stream; its schema is that of the table now. A table of one file is read from its parent.

    files_per_batch: how many new files a batch takes at most; all by default.
    """
    path = table_path(base, table)
    now = spark.read.parquet(path)
    reader = spark.readStream.schema(now.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if any(f.rstrip("/").endswith(f"{table}.parquet") for f in now.inputFiles()[:1]):
        rows = reader.option("pathGlobFilter", f"{table}.parquet").parquet(base)
    else:
        rows = reader.parquet(path)
    # watermarks need timestamps with a zone; those without are read in the session's
    return rows.select(*(F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in now.dtypes))


def run_once(stream: DataFrame) -> DataFrame:
    """Runs a stream over what there is now, into a written table in the shared folder, and reads that table."""
    folder = f"{ensure_checkpoint_dir(stream.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def once(messages: DataFrame, key: str = "input_id", time: str = "received_at", late: str = "7 days") -> DataFrame:
    """Each message once, remembering keys for as long as a delivery may be late."""
    return messages.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def stream_words(messages: DataFrame, lexicon: Lexicon, key: str = "input_id", text: str = "original") -> DataFrame:
    """``key, received_at, pos, word, tag``: words with their first tag; stateless, so that any stream can take it."""
    sense = lexicon.default_senses().select(F.col("word").alias("_w"), F.col("pos").alias("_p"))
    sense = broadcast_if_small(sense)
    words = messages.where(F.col(text).isNotNull()).select(key, "received_at", F.posexplode(cleaning.words_of(F.col(text))).alias("pos", "word"))
    return words.join(sense, F.lower("word") == F.col("_w"), "left").select(key, "received_at", "pos", "word", F.coalesce("_p", F.lit("FW")).alias("tag"))


def tag_counts(words: DataFrame, window: str = "30 days") -> DataFrame:
    """Tags per window of arrival, by the words' own watermark; a window is put out when no later message is waited for."""
    return words.groupBy(F.window("received_at", window), "tag").agg(F.count("*").alias("tokens"))
