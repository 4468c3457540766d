"""Shared-storage helpers: lineage cuts, scratch tables and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side must hold no more rows than this; wider tables are joined by shuffle.
BROADCAST_ROWS = 100_000


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the jobs rely on.

    The JIT does not compile methods above 8000 bytes; beyond that size whole-stage code runs
    interpreted and plain generated expressions are faster.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it in spark.checkpoint.dir.

    Only a local-mode session may fall back to a temporary folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="evalweave-")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_passing: list[list[str]] = []  # scratch tables of the blocks of ``passing_tables`` that are open


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Scratch tables that are cut inside are deleted at the end of the block, save those cut by the function it gives.

    What leaves the block must read no other scratch table of it.
    """
    made: list[str] = []
    _passing.append(made)

    def keep(df: DataFrame) -> DataFrame:
        kept = cut(df)
        made.pop()
        return kept

    try:
        yield keep
    finally:
        _passing.remove(made)
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows once to a scratch table and go on from it.

    Fixes the rows, ends the lineage on shared storage, so that it survives the loss of
    executors, and lets later steps read only the columns they need.
    """
    path = scratch_path(df.sparkSession, "cut")
    if _passing:
        _passing[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Fix a lookup side and broadcast it only when its counted rows stay within the limit."""
    fixed = cut(df)
    return F.broadcast(fixed) if fixed.count() <= limit else fixed
