"""Session helpers: local sessions for tests, the shared folder for checkpoints, checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = "*", partitions: int = 8, name: str = "textloom") -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the one set on the context; in local mode (tests) one of its own.

    On a cluster the folder has to be one that all machines share, so that there is none to fall back on.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="textloom-checkpoint-"))
    return shared or context.getCheckpointDir()


#: Rows and bytes up to which a table is broadcast; both are counted.
MAX_ROWS, MAX_BYTES = 200_000, 256 << 20
#: The same for a table of a few short columns, which takes some six times the bytes counted where it is broadcast.
NARROW_ROWS, NARROW_BYTES = 1_000_000, 32 << 20


def _size(df: DataFrame) -> Column:
    """About the bytes of a row: of its texts, 16 for every entry of an array or a map, 16 for anything else."""

    def one(name: str, kind: str) -> Column:
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(name), F.lit(0))
        return F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0)) * 16 if kind in ("array", "map") else F.lit(16)

    return sum((one(f"`{f.name}`", f.dataType.typeName()) for f in df.schema.fields), F.lit(0)).cast("long")


def is_small(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """Whether a table has no more rows and bytes than may be broadcast; ``max_rows + 1`` rows are read at most.

    A table that is dear to make should be written first, since it is made for this and for its use.
    """
    rows, size = df.limit(max_rows + 1).select(_size(df).alias("_b")).agg(F.count("*"), F.coalesce(F.sum("_b"), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is small, see ``is_small``, else unchanged, for a shuffled join."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that shuffles both sides. Without the hint Spark goes by the size of the compressed files that
    ``df`` comes from, a part of them for fewer columns and no more for rows made by explode, and may broadcast any table.
    """
    return df.hint("merge")


def dimension_join(rows: DataFrame, dim: DataFrame, on: Column, how: str = "left", salts: int = 16, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Many rows, of which a third may share a key, joined to a dimension; ``on`` compares columns of both.

    A dimension that is small, see ``is_small``, is broadcast. A larger one never is, see ``shuffled``: it is repeated
    once per salt and the rows are spread over the salts by a hash of all their columns that can be hashed, so that a hot
    key is split; how: inner, left, left_semi or left_anti, which a repeated right side leaves right.
    """
    if is_small(dim, max_rows, max_bytes):
        return rows.join(F.broadcast(dim), on, how)
    plain = [f.name for f in rows.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))
    spread = dim.withColumn("_salt_of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(shuffled(spread), on & (F.col("_salt") == F.col("_salt_of")), how).drop("_salt", "_salt_of")
