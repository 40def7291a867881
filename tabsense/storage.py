"""Where intermediate frames are written between passes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="tabsense-")
    sc.setCheckpointDir(path)
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage; survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write once as a columnar table and read it back: later passes scan only the columns they use."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, most_bytes: int) -> Iterator[None]:
    """Batches between Spark and Python hold about this much at most in what runs meanwhile, and one row at least."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, f"{most_bytes}b")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


# a lookup side of up to this many rows with texts of up to this many bytes is sent to every executor
BROADCAST_ROWS = 200_000
BROADCAST_TEXT = 32 << 20


def lookup_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The small side of a join, computed once and measured: broadcast if it fits, else left to a shuffle join.

    A broadcast keeps the large side where it is, so a hot key costs nothing;
    beyond the limit AQE splits the skewed partitions.
    """
    table = materialize(df)
    texts = [F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`"))), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    size = table.agg(F.count(F.lit(1)).alias("rows"), reduce(add, texts, F.lit(0)).alias("bytes")).first()
    return F.broadcast(table) if size["rows"] <= limit and size["bytes"] <= BROADCAST_TEXT else table


# a table of up to this many rows may come as a single split
SPREAD_ROWS = 5_000_000


def spread_out(df: DataFrame, rows: int) -> DataFrame:
    """Give a small table to all cores before Python works on it; leave a large one as it lies."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if rows <= SPREAD_ROWS else df


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
