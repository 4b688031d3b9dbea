"""Incremental keyed tables: merge, clean-up, skip rules and ingest windows."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom import fixed
from paperloom.functions.metadata import modified_or
from paperloom.operators.relational import in_both, in_set, met_keys, not_in, null_facts, without_pairs, without_wide
from paperloom.session import stored_copy


#: How stored tables are compressed.
CODEC = "zstd"
#: Bytes of a table by day that a merge rewrites at a time.
SLICE_BYTES = 256 << 20


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise when two rows share a key; only one offending key reaches the driver."""
    dup = df.groupBy(*keys).count().where("count > 1").take(1)
    if dup:
        raise ValueError(f"rows are not unique on {list(keys)}: {dup[0].asDict()}")


def upsert(target: DataFrame | None, source: DataFrame, keys: Sequence[str], check: bool = False) -> DataFrame:
    """Matched rows replaced, new rows added. ``target=None`` is the first, full run."""
    if check:
        assert_unique(source, keys)
    if target is None:
        return source
    return without_pairs(target, source, keys).unionByName(source)


def merge_into(spark: SparkSession, table: str, source: DataFrame, keys: Sequence[str]) -> None:
    """The same merge as one statement, for catalogs whose tables support MERGE."""
    source.createOrReplaceTempView("merge_source")
    on = " AND ".join(f"t.`{k}` = s.`{k}`" for k in keys)
    spark.sql(
        f"MERGE INTO {table} t USING merge_source s ON {on} "
        "WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *"
    )


def stale_documents(target: DataFrame, source: DataFrame) -> DataFrame:
    """Ids of documents known by uri whose (uri, md5_hash) pair is gone.

    The target has a row per chunk; its pairs are made distinct inside the map tasks.
    """
    pairs = target.select("uri", "md5_hash").distinct()
    known = in_set(source.select("document_id", "uri", "md5_hash"), pairs, "uri")
    return without_pairs(known, pairs, ["uri", "md5_hash"]).select("document_id").distinct()


def delete_stale_chunks(target: DataFrame, source: DataFrame) -> DataFrame:
    return target.join(stale_documents(target, source), "document_id", "left_anti")


def orphans(target: DataFrame, parents: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Keys ``DELETE ... WHERE key NOT IN (parents)`` would delete."""
    return not_in(target.select(key), parents, key)


def delete_orphans(target: DataFrame, parents: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``DELETE ... WHERE key NOT IN (parents)``: what is left is the rows that stay.

    When the parents hold a NULL, NOT IN is never true and nothing is deleted; a row whose
    own key is NULL also stays, unless there are no parents at all.
    """
    parent = parents.select(F.col(key).alias("_parent"))
    total, nulls = null_facts(parent, "_parent")
    held = target.where((F.col(key).isNull() | (nulls > 0)) & (total > 0))
    matched = target.where(F.col(key).isNotNull() & (nulls == 0)).join(
        parent, F.col(key) == F.col("_parent"), "left_semi"
    )
    return matched.unionByName(held)


def skip_unchanged(source: DataFrame, target: DataFrame | None, columns: Sequence[str]) -> DataFrame:
    """Rows whose (key, hash) pair the target does not hold yet; all rows on a full run."""
    if target is None:
        return source
    return without_pairs(source, target.select(*columns).distinct(), columns)


def skip_known(source: DataFrame, target: DataFrame | None, key: str) -> DataFrame:
    return source if target is None else not_in(source, target, key)


def skip_stored(source: DataFrame, target: DataFrame | None, columns: Sequence[str]) -> DataFrame:
    """``skip_unchanged`` for rows with texts, which are not moved to be compared."""
    return source if target is None else without_wide(source, target.select(*columns).distinct(), columns)


def skip_known_texts(source: DataFrame, target: DataFrame | None, key: str) -> DataFrame:
    """``skip_known`` for rows with texts, with the NULL rules of ``not_in``."""
    if target is None:
        return source
    total, nulls = null_facts(target.select(key), key)
    rows = source.where((total == 0) | ((nulls == 0) & F.col(key).isNotNull()))
    return without_wide(rows, target.select(key).where(F.col(key).isNotNull()), [key])


def new_objects(source: DataFrame, ingested: DataFrame, path: str = "object_path") -> DataFrame:
    """Present in the source and not in the store."""
    return without_pairs(source, ingested, [path])


def backfill_updated_at(staged: DataFrame, raw: DataFrame, pdf_only: bool = True) -> DataFrame:
    """Set ``updated_at`` to the feed time, or the object time; unmatched rows stay as they are."""
    rows = raw.where("content_type = 'application/pdf'") if pdf_only else raw
    fresh = rows.select("uri", modified_or("metadata", "updated").alias("_fresh"))
    return (
        staged.join(fresh, "uri", "left")
        .withColumn("updated_at", F.coalesce("_fresh", "updated_at"))
        .select(*staged.columns)
    )


def propagate_updated_at(documents: DataFrame, staged: DataFrame) -> DataFrame:
    fresh = staged.select("document_id", F.col("updated_at").alias("_fresh"))
    return (
        documents.join(fresh, "document_id", "left")
        .withColumn("updated_at", F.coalesce("_fresh", "updated_at"))
        .select(*documents.columns)
    )


def time_window(
    df: DataFrame,
    start: dt.datetime | str | None,
    end: dt.datetime | str | None,
    updated: str = "updated",
    exact: Column | None = None,
) -> DataFrame:
    """Rows whose time lies in [start, end); no filter unless both bounds are given.

    The exact time comes from nested metadata and cannot be pushed to the scan, so a coarse
    range on the raw column, one day wider at the end, goes first.
    """
    if start is None or end is None:
        return df
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    at = modified_or("metadata", updated) if exact is None else exact
    coarse = (F.col(updated) >= lo) & (F.col(updated) < hi + F.expr("interval 1 day"))
    return df.where(coarse).where((at >= lo) & (at < hi))


def run_window(
    now: dt.datetime, hours: int = fixed.INGEST_HOURS, start: dt.datetime | None = None, end: dt.datetime | None = None
) -> tuple[dt.datetime, dt.datetime]:
    """Bounds of one run: the last full ``hours``, unless both bounds are given."""
    if start is not None and end is not None:
        return start, end
    stop = now.replace(minute=0, second=0, microsecond=0)
    return stop - dt.timedelta(hours=hours), stop


def assign_window(df: DataFrame, ts: str, hours: int = fixed.INGEST_HOURS) -> DataFrame:
    """Half-open ingest window of every row, aligned to the hour."""
    w = F.window(F.col(ts), f"{hours} hours")
    return df.withColumn("window_start", w["start"]).withColumn("window_end", w["end"])


def rows_per_window(df: DataFrame, ts: str, hours: int = fixed.INGEST_HOURS) -> DataFrame:
    return assign_window(df, ts, hours).groupBy("window_start", "window_end").agg(F.count("*").alias("n_rows"))


class KeyedTable:
    """A table kept as complete versions in one folder; readers see the newest finished one.

    A merge reads version n and writes version n+1, so it never overwrites what it reads,
    and a run that dies half-way leaves no trace but an unfinished folder. One writer at a
    time. Where a catalog offers MERGE, ``merge_into`` is the better choice.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def _fs(self):
        jvm = self.spark._jvm
        home = jvm.org.apache.hadoop.fs.Path(self.path)
        return home.getFileSystem(self.spark._jsc.hadoopConfiguration()), home, jvm.org.apache.hadoop.fs.Path

    def _versions(self) -> list[int]:
        fs, home, make = self._fs()
        if not fs.exists(home):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(home)]
        return sorted(
            int(n[1:])
            for n in names
            if n.startswith("v") and n[1:].isdigit() and fs.exists(make(f"{self.path}/{n}/_SUCCESS"))
        )

    def _folder(self, version: int) -> str:
        return f"{self.path}/v{version:08d}"

    def read(self) -> DataFrame | None:
        done = self._versions()
        return self.spark.read.parquet(self._folder(done[-1])) if done else None

    def overwrite(self, df: DataFrame) -> DataFrame:
        done = self._versions()
        df.write.mode("overwrite").option("compression", CODEC).parquet(self._folder(done[-1] + 1 if done else 1))
        return self.read()

    def merge(self, source: DataFrame, check: bool = True, drop: DataFrame | None = None, fresh: bool = False) -> DataFrame:
        """Upsert ``source``; rows matching the columns of ``drop`` are deleted first. ``fresh`` says
        that no key of the source is in the table after that."""
        if check:
            assert_unique(source, self.keys)
        target = self.read()
        if target is None:
            return self.overwrite(source)
        if drop is not None:
            target = without_wide(target, drop, drop.columns)
        if not fresh:
            target = without_wide(target, source, self.keys)
        return self.overwrite(target.unionByName(source))

    def expire(self, keep: int = 2) -> None:
        """Drop all but the newest ``keep`` finished versions."""
        fs, _, make = self._fs()
        for version in self._versions()[:-keep]:
            fs.delete(make(self._folder(version)), True)


def with_lookup(writer: DataFrameWriter, columns: Sequence[str]) -> DataFrameWriter:
    """Bloom filters on ``columns`` in Parquet files: a search for one value skips the row groups
    without it, in files that are sorted by something else too. Filters are as large as the values
    of a row group ask for; adaptive sizes are a setting of the file, not of a column, and without
    them each filter takes 1 MB."""
    for c in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.candidates.number#{c}", "12")
    return writer.option("parquet.bloom.filter.adaptive.enabled", "true") if columns else writer


class DatedTable:
    """A table in one folder per day, or per value of another column; a merge rewrites only the
    days it touches.

    Touched are the days of the new rows and the days that hold an older copy of one, or a
    row to drop; they are found on the key columns alone. The merged rows are written to the
    shared folder first and from there over the touched days, so nothing is read while it is
    replaced and a repeated merge ends in the same table. One writer at a time. Columns of
    ``lookup`` get filters by which a point read passes over row groups.
    """

    def __init__(
        self, spark: SparkSession, path: str, keys: Sequence[str], day: str, cluster: Sequence[str] = (), lookup: Sequence[str] = ()
    ):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.day, self.cluster, self.lookup = day, list(cluster), list(lookup)

    def _fs(self):
        jvm = self.spark._jvm
        make = jvm.org.apache.hadoop.fs.Path
        return make(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), make

    def read(self) -> DataFrame | None:
        fs, make = self._fs()
        if not fs.exists(make(f"{self.path}/_SUCCESS")):
            return None
        # The schema is stored: neither a table without rows nor one of undated rows has files to tell it.
        kept = self.spark.read.text(f"{self.path}-schema").first()
        return self.spark.read.schema(T.StructType.fromJson(json.loads(kept[0]))).parquet(self.path)

    def overwrite(self, df: DataFrame) -> DataFrame:
        """Replace the whole table. ``df`` may read it: its rows are written aside first."""
        fields = [f for f in df.schema if f.name != self.day] + [T.StructField(self.day, df.schema[self.day].dataType)]
        schema = self.spark.createDataFrame([(T.StructType(fields).json(),)], "schema string")
        if self.read() is None:
            schema.coalesce(1).write.mode("overwrite").text(f"{self.path}-schema")
            self._write(df, "static")
        else:
            with stored_copy(df, "rebuild") as rows:
                schema.coalesce(1).write.mode("overwrite").text(f"{self.path}-schema")
                self._write(rows, "static")
        return self.read()

    def merge(self, source: DataFrame, check: bool = True, drop: DataFrame | None = None, fresh: bool = False) -> DataFrame:
        """Upsert ``source``; rows matching the columns of ``drop`` are deleted first. ``fresh`` says
        that no key of the source is in the table after that."""
        if check:
            assert_unique(source, self.keys)
        target = self.read()
        if target is None:
            return self.overwrite(source)
        kept, touched = target, source.select(self.day)
        left_out = [] if drop is None else [(drop, drop.columns)]
        for other, columns in left_out if fresh else [*left_out, (source, self.keys)]:
            met = met_keys(target, other, columns, self.day)
            places = in_both(target.select(*columns, self.day), other, columns) if met is None else met
            touched = touched.unionByName(places.select(self.day))
            kept = without_wide(kept, other, columns, met)
        days = [r[0] for r in touched.distinct().collect()]  # one value per folder
        for some in self._slices(days):
            self._rewrite(some, kept, source)
        return self.read()

    def _slices(self, days: list) -> list[list]:
        """``days`` in lists that hold about ``SLICE_BYTES`` each, as rewriting takes thrice its bytes."""
        fs, make = self._fs()
        held = fs.getContentSummary(make(self.path)).getLength()
        n = max(1, min(len(days), -(-held // SLICE_BYTES)))
        return [days[k::n] for k in range(n) if days[k::n]]

    def _rewrite(self, days: list, kept: DataFrame, source: DataFrame) -> None:
        inside = F.col(self.day).isin([d for d in days if d is not None])
        if None in days:
            inside = inside | F.col(self.day).isNull()
        rows = kept.where(inside).unionByName(source.where(inside).select(*kept.columns))
        with stored_copy(rows, "merge") as merged:
            left = {r[0] for r in merged.select(self.day).distinct().collect()}
            self._write(merged, "dynamic")
        fs, make = self._fs()
        for gone in set(days) - left:
            name = "__HIVE_DEFAULT_PARTITION__" if gone is None else str(gone)
            fs.delete(make(f"{self.path}/{self.day}={name}"), True)

    def _write(self, df: DataFrame, mode: str) -> None:
        rows = df.hint("rebalance", F.col(self.day)).sortWithinPartitions(self.day, *self.cluster)
        writer = with_lookup(rows.write.mode("overwrite"), self.lookup).option("partitionOverwriteMode", mode).option("compression", CODEC)
        writer.partitionBy(self.day).parquet(self.path)
