"""Join and window shapes used all over the jobs."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.session import cut_lineage


def null_facts(keys: DataFrame, column: str) -> tuple[Column, Column]:
    """Row count and NULL count of a key column, as one one-row scalar subquery."""
    facts = keys.agg(
        F.struct(F.count("*").alias("n"), F.count_if(F.col(column).isNull()).alias("nulls")).alias("facts")
    ).scalar()
    return facts["n"], facts["nulls"]


def not_in(df: DataFrame, other: DataFrame, column: str, other_column: str | None = None) -> DataFrame:
    """``column NOT IN (SELECT other_column ...)`` with SQL's NULL rules.

    A NULL on the inner side empties the result; a NULL key survives only an empty inner
    side. Spark's own null-aware anti join must broadcast the inner side whatever its size;
    here the NULL facts are a scalar subquery and the rest is a plain anti join. Rows with a
    NULL key leave before the join, so they never pile up on one task.
    """
    inner = other.select(F.col(other_column or column).alias("_inner"))
    total, nulls = null_facts(inner, "_inner")
    rows = df.where((total == 0) | ((nulls == 0) & F.col(column).isNotNull()))
    return rows.join(inner.where("_inner is not null"), F.col(column) == F.col("_inner"), "left_anti")


def in_set(df: DataFrame, other: DataFrame, column: str, other_column: str | None = None) -> DataFrame:
    """``column IN (SELECT other_column ...)``: rows are kept, never multiplied."""
    inner = other.select(F.col(other_column or column).alias("_inner"))
    return df.join(inner, F.col(column) == F.col("_inner"), "left_semi")


def without_pairs(df: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``NOT EXISTS`` on several columns: rows whose column pair is not present in ``other``."""
    return df.join(other.select(*columns), list(columns), "left_anti")


#: Hashes of keys up to this many are sent to all tasks.
FEW_KEYS = 2_000_000
_HASHED = (T.StringType, T.IntegralType, T.DateType, T.TimestampType, T.BooleanType)


def met_keys(df: DataFrame, other: DataFrame, columns: Sequence[str], *also: str) -> DataFrame | None:
    """(_h, also): hashes of the keys of ``df`` that ``other`` may have too, written once.

    Equal keys have equal hashes, so keys that are not here are in ``df`` alone. None where equal
    values of the two sides could differ in their hash.
    """
    types = [(df.schema[c].dataType, other.schema[c].dataType) for c in columns]
    if any(a != b or not isinstance(a, _HASHED) for a, b in types):
        return None
    h = F.xxhash64(*columns).alias("_h")
    met = df.select(h, *also).distinct().join(other.select(h), "_h", "left_semi")
    return cut_lineage(met, "met-keys")


def without_wide(
    df: DataFrame, other: DataFrame, columns: Sequence[str], met: DataFrame | None = None, few: int | None = None
) -> DataFrame:
    """``without_pairs`` for rows with texts: only keys are moved to find the rows that may be present.

    Rows whose hash the other side lacks stay where they are; the others, if their keys or those
    that are left are few, are told apart by a broadcast and compared exactly.
    """
    few = FEW_KEYS if few is None else few
    met = met_keys(df, other, columns) if met is None else met
    if met is None:
        return without_pairs(df, other, columns)
    met = met.select(F.col("_h").alias("_met")).distinct()
    n = met.limit(few + 1).count()
    if n == 0:
        return df
    same = F.xxhash64(*columns) == F.col("_met")
    if n <= few:
        alone = df.join(F.broadcast(met), same, "left_anti")
        return alone.unionByName(without_pairs(df.join(F.broadcast(met), same, "left_semi"), other, columns))
    fresh = without_pairs(df.select(*columns), other, columns).select(F.xxhash64(*columns).alias("_met")).distinct()
    fresh = cut_lineage(fresh, "fresh-keys")
    if fresh.limit(few + 1).count() <= few:
        df = df.join(F.broadcast(fresh), same, "left_semi")
    return without_pairs(df, other, columns)


def near_keys(df: DataFrame, keys: DataFrame, columns: Sequence[str], few: int | None = None) -> DataFrame:
    """The rows of ``df`` that have one of the written ``keys``, and any others: fewer rows for a join
    to move. Hashes of few keys are sent to the tasks; with more of them all rows stay."""
    few = FEW_KEYS if few is None else few
    types = [(df.schema[c].dataType, keys.schema[c].dataType) for c in columns]
    if any(a != b or not isinstance(a, _HASHED) for a, b in types):
        return df
    met = keys.select(F.xxhash64(*columns).alias("_met")).distinct()
    if met.limit(few + 1).count() > few:
        return df
    return df.join(F.broadcast(met), F.xxhash64(*columns) == F.col("_met"), "left_semi")


def in_both(df: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose column pair is present in ``other``; rows are never multiplied."""
    return df.join(other.select(*columns), list(columns), "left_semi")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """First ``n`` rows per group.

    ``row_number() <= n`` lets Spark cut every group to ``n`` rows before the shuffle, so a
    hot group sends ``n`` rows per task and no more.
    """
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def last_rows(df: DataFrame, group: Sequence[str], position: str, n: int) -> DataFrame:
    """The ``n`` rows with the highest position per group."""
    return top_per_group(df, group, [F.col(position).desc()], n)


def first_wins(df: DataFrame, key: Sequence[str], position: Sequence[str]) -> DataFrame:
    return top_per_group(df, key, [F.col(p).asc() for p in position], 1)


def last_wins(df: DataFrame, group: Sequence[str], key: str, position: str, values: Sequence[str]) -> DataFrame:
    """Keep the last value per key, placed where the key was first seen."""
    return df.groupBy(*group, key).agg(
        F.min(position).alias("first_position"),
        *[F.max_by(F.col(v), F.col(position)).alias(v) for v in values],
    )


def ordered_text(value: Column | str, separator: str, order: str) -> Column:
    """``STRING_AGG(value, separator ORDER BY order)`` as an aggregate column."""
    value = F.col(value) if isinstance(value, str) else value
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), value.alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), separator)


def numbered(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``df``, written once, with gapless numbers from 0 as ``number``, and how many rows there are.

    The rows are not moved: each partition's count, the only thing that reaches the driver, says
    where its numbers start.
    """
    rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()), label)
    part, place = F.shiftright("_row", 33), F.col("_row").bitwiseAND((1 << 33) - 1)
    counts = sorted(tuple(r) for r in rows.groupBy(part.alias("part")).count().collect())
    starts = list(accumulate([n for _, n in counts], initial=0))
    offsets = df.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(counts, starts)], "_part long, _start long")
    found = rows.join(F.broadcast(offsets), part == F.col("_part"))
    return found.withColumn("number", F.col("_start") + place).drop("_row", "_part", "_start"), starts[-1]


#: Rows of a task after ``spread``, where they fill more tasks than there are cores.
SPREAD_ROWS = 100_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores when the rows of a scan lie in fewer partitions than there are.

    Files are cut by bytes, but a row group is read whole by one task, so a file of few row groups
    leaves most of its partitions without rows. The rows of each partition are counted, which opens
    no column; a scan whose fullest partition has two cores' shares at most is left as it is, others
    cost one small shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    total, most = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if df.rdd.getNumPartitions() >= cores and most * cores <= 2 * total:
        return df
    n = max(cores, -(-total // SPREAD_ROWS))
    return df.repartition(n, *keys) if keys else df.repartition(n)
