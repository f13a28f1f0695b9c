from datetime import datetime, timedelta

from pyspark.sql import functions as F

from textloom.streaming import messages as M

START = datetime(2024, 1, 1)
SCHEMA = "input_id long, original string, received_at timestamp"


def _stream(spark, tmp_path, *batches):
    """A table of one file per batch, in order of time, read a file at a time."""
    import os
    import time

    folder = tmp_path / "tokenized_input.parquet"
    folder.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame([(i, t, START + timedelta(days=d)) for i, t, d in rows], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
        (own,) = (tmp_path / f"b{k}").glob("*.parquet")
        own.rename(folder / f"{k}.parquet")
        os.utime(folder / f"{k}.parquet", (time.time() - 100 + k,) * 2)
    return M.message_stream(spark, str(tmp_path), files_per_batch=1)


def test_deliveries_of_different_batches_count_once(spark, tmp_path):
    s = _stream(spark, tmp_path, [(1, "a", 0), (2, "b", 0)], [(1, "a", 1), (3, "c", 1)], [(4, "d", 60)], [(5, "e", 61)], [(2, "b", 62)])
    got = sorted(r["input_id"] for r in M.run_once(M.once(s)).collect())
    assert got == [1, 2, 2, 3, 4, 5]  # 2 came again long after deliveries are remembered


def test_late_messages_are_waited_for_and_then_left_out(spark, tmp_path):
    """A message five days late counts; one that comes when its window is over does not."""
    s = _stream(spark, tmp_path, [(1, "x", 1)], [(2, "x", 34)], [(3, "x", 29)], [(4, "x", 100)], [(5, "x", 2)], [(6, "x", 200)])
    words = s.withWatermark("received_at", "7 days").select("received_at", F.lit("NN").alias("tag"))
    got = {r["window"]["start"].date().isoformat(): r["tokens"] for r in M.run_once(M.tag_counts(words)).collect()}
    whole = {}
    for d in (1, 34, 29, 100):
        begin = datetime(1970, 1, 1) + timedelta(days=(START + timedelta(days=d) - datetime(1970, 1, 1)).days // 30 * 30)
        whole[begin.date().isoformat()] = whole.get(begin.date().isoformat(), 0) + 1
    assert got == whole
