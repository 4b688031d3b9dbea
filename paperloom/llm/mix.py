"""Mixing sources to target weights by exact token budgets.

A source's target is its weight's share of all tokens, at most ``LIMIT`` times its own size; what
the limit leaves over goes to the other sources by weight, until none is above its limit. Each
row gets a hash-random key; rows are sorted by range within their source, and distributed prefix
sums of their sizes say where the budget ends. A source is repeated whole as often as its target
holds it; the rest of the budget is cut from the start of the order, in the middle of a row if
need be, so each source gives its target to within one token.

Sizes are counts of words ``[^\\x20\\x09-\\x0D]+``. Nulls: a null text has size 0; null sources
are one source, the last; a null id has a key like any other. Repeated rows are told apart by
their place in the input, and results do not depend on which is which. An empty table gives an
empty result. Other columns are ignored by ``budgets`` and carried by ``copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.store import few, query, table, written

WEIGHTS = (5, 2, 1)
LIMIT = 3
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def _key(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(str(seed))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    With the sources in the order of limit over weight, the first k are at their limit; the level
    that the others share follows from sums over the sources before and after.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long")
    rows = sizes.withColumn("weight", weight).withColumn("most", limit * F.col("source_size"))
    filled = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    rows = rows.withColumn("level", (total - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after))
    # The level rises with every source at its limit and falls after the last of them.
    share = F.max("level").over(everything) * F.col("weight")
    return rows.select("source", "source_size", F.least(F.col("most").cast("double"), share).alias("target"))


def budgets(docs: DataFrame, id_column: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: (doc_id, source, key, size, source_size, target, taken)."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col("source").cast("string"), n_words().alias("size"))
    rows = rows.withColumn("key", _key(seed)).withColumn("tie", F.monotonically_increasing_id())
    order = ["key", "doc_id", "size", "tie"]
    dealt = rows.repartitionByRange("source", *order).withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "mix")
    parts = dealt.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    sums = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum("part_size").over(sums), F.lit(0)))
    whole = targets(dealt.groupBy("source").agg(F.sum("size").alias("source_size")), weights, limit)
    whole = whole.withColumnRenamed("source", "t_source")
    parts = parts.join(whole, F.col("source").eqNullSafe(F.col("t_source")))
    parts = parts.select(F.col("source").alias("p_source"), F.col("part").alias("p_part"), "offset", "source_size", "target")
    run = Window.partitionBy("source", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0)))
    dealt = dealt.join(parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part")))
    budget = F.floor("target")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0)
    left = budget - rounds * F.col("source_size") - F.col("offset") - F.col("before")
    taken = rounds * F.col("size") + F.greatest(F.least(left, F.col("size")), F.lit(0))
    return dealt.select("doc_id", "source", "key", "size", "source_size", "target", taken.cast("long").alias("taken"))


def copies(docs: DataFrame) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, in whole rows: a row whose share of
    the last round is half or more is taken whole. Rows alike in id, source and size go together
    in the last round."""
    rows = budgets(docs)
    place = F.struct("key", "doc_id", "size")
    rounds = F.floor(F.floor("target") / F.greatest(F.col("source_size"), F.lit(1)))
    last = F.col("taken") - rounds * F.col("size")
    cuts = rows.groupBy("source").agg(
        F.max(rounds).alias("rounds"), F.max(F.when((F.col("size") > 0) & (2 * last >= F.col("size")), place)).alias("cut")
    )
    cuts = few(cuts, "mix-cuts").select(F.struct("source", "rounds", "cut").alias("mix"))
    own = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("source"), "doc_id", n_words().alias("size"))
    own = own.withColumn("key", _key(SEED)).select("row", "source", place.alias("place"))
    found = own.join(cuts, F.col("source").eqNullSafe(F.col("mix.source")))
    extra = F.when(F.col("place") <= F.col("mix.cut"), 1).otherwise(0)
    times = F.col("mix.rounds") + extra
    return found.select("row", F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias("again")).select("row.*")


_ORACLE = f"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':{SEED}') AS key
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight
  FROM rows GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM sources WINDOW o AS (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source NULLS LAST)),
targets AS (
  SELECT source, source_size, least(3.0 * source_size,
    (SELECT max(level) FROM levels) * weight) AS target
  FROM levels),
placed AS (
  SELECT r.*, t.source_size, CAST(t.target AS DOUBLE) AS target, CAST(floor(t.target) AS BIGINT) AS budget,
    coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size > 0 THEN budget // source_size * size
    + greatest(least(budget - budget // source_size * source_size - before, size), 0) ELSE 0 END AS BIGINT) AS taken
FROM placed
"""


@query("op5_hash_mix", _ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes, repeats counted."""
    return budgets(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
