"""Written tables that cut lineage, and the given tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (session, folder of tables) under ``name``."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one."""
    path = scratch_path(spark, label)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` from a table in the shared folder: it is computed once and outlives executors."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders made inside the block by this thread, for ``remove`` once nothing reads them."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def few(df: DataFrame, label: str, limit: int = 100_000) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has ``limit`` rows at most."""
    rows = written(df, label)
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows
