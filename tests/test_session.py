import pytest
from pyspark.sql import functions as F

from textloom.session import dimension_join, ensure_checkpoint_dir, is_small


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_both_ways_of_a_dimension_join_agree(spark, how):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else str(i), {"m": i}) for i in range(300)] + [(999, None, None)], "id int, k string, m map<string,int>")
    dim = spark.createDataFrame([("hot", 1), ("6", 2), ("9", 3), ("none", 4)], "key string, v int")
    few, many = (sorted(map(str, dimension_join(rows, dim, F.col("k") == F.col("key"), how, max_rows=n).collect())) for n in (100, 2))
    assert few == many and few


def test_there_is_a_checkpoint_folder(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or ensure_checkpoint_dir(spark) == named


def test_a_dimension_is_measured_by_rows_and_bytes(spark):
    wide = spark.createDataFrame([("x" * 1000, [1] * 100, {"a": 1}, 1)] * 50, "s string, a array<int>, m map<string,int>, i int")
    assert is_small(wide, 50) and not is_small(wide, 49) and not is_small(wide, 50, 50_000) and is_small(wide.limit(0), 0, 0)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_a_large_dimension_is_never_broadcast(spark, tmp_path, how):
    # its file is far below Spark's own limit for broadcasts, as that of a large dictionary is
    spark.range(1000).selectExpr("cast(id as string) as key", "id as v").write.parquet(f"{tmp_path}/dim")
    rows = spark.range(5000).selectExpr("cast(id as string) as k")
    joined = dimension_join(rows, spark.read.parquet(f"{tmp_path}/dim"), F.col("k") == F.col("key"), how, max_rows=10)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert joined.count() == {"left": 5000, "inner": 1000, "left_semi": 1000, "left_anti": 4000}[how]


@pytest.mark.parametrize("max_rows, max_bytes, sent", [(50, 2000, True), (49, 2000, False), (50, 800, False)])
def test_a_join_has_limits_of_rows_and_of_bytes(spark, max_rows, max_bytes, sent):
    rows, dim = (spark.range(50).selectExpr(f"cast(id as string) as {name}", f"id as {name}_v") for name in ("k", "key"))
    joined = dimension_join(rows, dim, F.col("k") == F.col("key"), max_rows=max_rows, max_bytes=max_bytes)
    assert ("BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()) == sent and joined.count() == 50
