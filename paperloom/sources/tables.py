"""Readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.text import last_segment
from paperloom.sources import hashing

RULES_SCHEMA = T.StructType(
    [
        T.StructField("document_type", T.StringType()),
        T.StructField("label_ja", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("sort_order", T.LongType()),
    ]
)

RAW_SCHEMA = T.StructType(
    [
        T.StructField("uri", T.StringType()),
        T.StructField("generation", T.LongType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("md5_hash", T.StringType()),
        T.StructField(
            "metadata",
            T.ArrayType(
                T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])
            ),
        ),
        T.StructField("updated", T.TimestampType()),
    ]
)

SYNC_HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("calendar_event_id", T.StringType()),
        T.StructField("synced_at", T.TimestampType()),
        T.StructField("synced_by", T.StringType()),
    ]
)


def scan_objects(
    spark: SparkSession,
    path: str,
    pattern: str = "*.pdf",
    content_type: str = "application/pdf",
    sidecar: DataFrame | None = None,
    content: bool = False,
    hash_content: bool | None = None,
    slice_bytes: int = hashing.SLICE,
) -> DataFrame:
    """One row per stored file: uri, size, md5, time and the metadata of a sidecar table.

    Where the sidecar has an ``md5_hash``, as a store keeps one, the files are only listed and none
    is opened. Without it, or with ``hash_content=True``, the scan tasks read the bytes for the hash;
    ``hash_content=False`` leaves it null. Bytes are part of the result only with ``content=True``.
    Files over ``slice_bytes`` are read in splits and hashed by the slice before this returns, so a file may
    have any size; with ``content=True``, and where a name says that a file is packed, one task reads a file.
    """
    known = sidecar is not None and "md5_hash" in sidecar.columns
    hash_content = not known if hash_content is None else hash_content
    options = {"pathGlobFilter": pattern, "recursiveFileLookup": "true"}
    files = spark.read.format("binaryFile").options(**options).load(path)

    def listed(some: DataFrame, md5_hash: Column) -> DataFrame:
        return some.select(
            F.col("path").alias("uri"),
            F.unix_micros("modificationTime").alias("generation"),
            F.lit(content_type).alias("content_type"),
            F.col("length").alias("size"),
            md5_hash.alias("md5_hash"),
            F.col("modificationTime").alias("updated"),
            *(["content"] if content else []),
        )

    sliced = (F.col("_metadata.file_size") > slice_bytes) & ~F.col("_metadata.file_path").rlike(hashing.PACKED)
    large = files.where(sliced).select("*", F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"))
    counts = hashing.slice_counts(large.select("size"), slice_bytes) if hash_content and not content else []
    if counts:
        texts = spark.read.options(**options).option("lineSep", "\n").text(path).where(sliced)
        hashes = hashing.file_hashes(large.select("file", "size"), texts, counts, slice_bytes)
        rows = listed(files.where(~sliced), F.md5("content")).unionByName(listed(large.join(hashes, "file"), F.col("hash")))
    else:
        rows = listed(files, F.md5("content") if hash_content else F.lit(None).cast("string"))
    if sidecar is None:
        empty = F.array().cast("array<struct<name:string,value:string>>")
        return rows.withColumn("metadata", empty)
    if not known or hash_content:
        return rows.join(sidecar.select("uri", "metadata"), "uri", "left")
    return rows.drop("md5_hash").join(sidecar.select("uri", "md5_hash", "metadata"), "uri", "left").select(*rows.columns, "metadata")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RULES_SCHEMA).option("header", True).option("multiLine", True).csv(path)


def read_ndjson(spark: SparkSession, prefix: str, schema: T.StructType | str) -> DataFrame:
    """All shards under a prefix; blank lines are skipped and a bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(prefix)


def read_document_text(staged: DataFrame, document_id: str) -> DataFrame:
    """Stored text of one document; the id filter reaches the scan."""
    return staged.where(F.col("document_id") == document_id).select("document_id", "extracted_markdown")


def export_ndjson(df: DataFrame, path: str, columns: Sequence[str], explicit_nulls: bool = False) -> None:
    """Overwrite a shard set of JSON lines with the listed columns, one file per task."""
    df.select(*columns).write.mode("overwrite").option(
        "ignoreNullFields", str(not explicit_nulls).lower()
    ).json(path)


def write_partitioned(
    df: DataFrame,
    path: str,
    by: str,
    cluster: Sequence[str] = (),
    value: Column | None = None,
) -> None:
    """Partition by a date column and sort files by the cluster columns.

    ``rebalance`` gathers each date into few files and lets AQE split a date that is too
    large for one task, so one heavy day does not become one straggler.
    """
    rows = df if value is None else df.withColumn(by, value)
    rows = rows.hint("rebalance", F.col(by)).sortWithinPartitions(by, *cluster)
    rows.write.mode("overwrite").partitionBy(by).parquet(path)


def rebuild(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """``SELECT ... UNION ALL SELECT ...`` of rows that stand in the query."""
    return spark.createDataFrame(list(rows), schema)


def empty_table(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def file_name(path: Column | str) -> Column:
    return last_segment(path)
