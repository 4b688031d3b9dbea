"""Structured Streaming jobs; the column logic is shared with their batch forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from paperloom import fixed
from paperloom.functions.text import _col
from paperloom.operators.relational import top_per_group
from paperloom.session import stored_copy
from paperloom.sources.state import DatedTable, KeyedTable


class BatchLedger:
    """Which micro-batches of a stream are merged: one folder per batch, made after its merge."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def has(self, batch_id: int) -> bool:
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={batch_id}/_SUCCESS")
        return done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)

    def add(self, batch_id: int) -> None:
        row = self.spark.range(1).select(F.current_timestamp().alias("merged_at"))
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self) -> DataFrame:
        return self.spark.read.schema("merged_at timestamp, batch bigint").parquet(self.path)


def ingest_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    table: KeyedTable | DatedTable,
    checkpoint: str,
    pattern: str = "*.json",
    format: str = "json",
    newest: str | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Merge every new file under ``path`` into a keyed table, once, then stop.

    Meant to be started by a scheduler every few hours. The checkpoint remembers which files
    were taken, and the ledger beside it which batches are merged: one that is replayed because
    the run ended before its checkpoint did is recognised and merged no second time. A run that
    ends between merge and ledger merges again, to the same table. With a ``DatedTable`` only the
    days that a batch touches are rewritten. Several rows per key in a batch are settled by the
    highest ``newest`` column.
    """
    ledger = BatchLedger(spark, f"{checkpoint.rstrip('/')}-ledger")
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.format(format).load(path)

    def merge(batch: DataFrame, batch_id: int) -> None:
        if ledger.has(batch_id):
            return
        one = batch if prepare is None else prepare(batch)
        if newest is not None:
            rest = [F.col(c) for c in one.columns if c not in table.keys and c != newest]
            one = top_per_group(one, table.keys, [F.col(newest).desc(), *rest])
        table.merge(one, check=newest is None)
        ledger.add(batch_id)

    return (
        rows.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def rates(
    df: DataFrame,
    ts: str,
    value: Column | str | None = None,
    width: str = fixed.ALERT_WIDTH,
    late: str | None = None,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Count, or sum of ``value``, per second over tumbling windows; batch or stream.

    Rows are combined inside each task before the shuffle, so one busy minute is no hot spot.
    """
    seconds = _seconds(width)
    rows = df if late is None else df.withWatermark(ts, late)
    total = F.count("*").cast("double") if value is None else F.sum(_col(value))
    return (
        rows.groupBy(F.window(ts, width).alias("w"), *by)
        .agg(total.alias("total"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            *by,
            "total",
            (F.col("total") / seconds).alias("rate"),
        )
    )


def _seconds(width: str) -> float:
    number, unit = width.split()
    units = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    return float(number) * units[unit.rstrip("s")]


def rate_alert(
    df: DataFrame,
    ts: str,
    value: Column | str | None = None,
    threshold: float = fixed.REQUESTS_PER_SECOND,
    width: str = fixed.ALERT_WIDTH,
    late: str | None = None,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Windows whose rate is above the threshold."""
    return rates(df, ts, value, width, late, by).where(F.col("rate") > threshold)


def alert_stream(
    rows: DataFrame,
    ts: str,
    table: KeyedTable | DatedTable,
    checkpoint: str,
    value: Column | str | None = None,
    threshold: float = fixed.REQUESTS_PER_SECOND,
    width: str = fixed.ALERT_WIDTH,
    late: str = "10 minutes",
    by: tuple[str, ...] = (),
    closed: bool = False,
) -> StreamingQuery:
    """Keep the alerts of a stream in ``table`` (keys: window_start and ``by``).

    Every window that a batch changes is looked at anew: one above the threshold is stored with its
    rate so far, one that fell back is withdrawn. With ``closed`` a window is looked at once, when the
    watermark has passed its end, so an alert is final. Takes what is there and stops.
    """
    seen = rates(rows, ts, value, width, late, by)
    if isinstance(table, DatedTable):
        seen = seen.withColumn(table.day, F.to_date("window_start"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        with stored_copy(batch, "rates") as changed:
            above = F.coalesce(F.col("rate") > threshold, F.lit(False))
            table.merge(changed.where(above), drop=changed.where(~above).select("window_start", *by))

    return (
        seen.writeStream.outputMode("append" if closed else "update")
        .foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def project_access_log(df: DataFrame, project: str | None = None) -> DataFrame:
    """Log rows with level, severity and trace fields; stateless, batch or stream."""
    level = (
        F.when(F.col("status") >= 500, F.lit("error")).when(F.col("status") >= 400, F.lit("warn")).otherwise(F.lit("info"))
    )
    message = (
        F.when(F.col("status") >= 500, F.lit("HTTP request failed"))
        .when(F.col("status") >= 400, F.lit("HTTP request client error"))
        .otherwise(F.lit("HTTP request completed"))
    )
    number = F.when(F.col("status") >= 500, 50).when(F.col("status") >= 400, 40).otherwise(30)
    parts = F.split(F.split("trace_header", ";", -1).getItem(0), "/", -1)
    trace = F.nullif(F.get(parts, 0), F.lit(""))
    span = F.when(trace.isNotNull(), F.nullif(F.get(parts, 1), F.lit("")))
    out = (
        df.withColumn("level", level)
        .withColumn("severity", severity(number))
        .withColumn("message", message)
        .withColumn("trace_id", trace)
        .withColumn("span_id", span)
    )
    if project is not None:
        out = out.withColumn("trace", F.concat(F.lit(f"projects/{project}/traces/"), trace))
    return out.drop("trace_header")


def severity(level_number: Column | str) -> Column:
    pairs = [F.lit(x) for item in fixed.SEVERITIES.items() for x in item]
    return F.coalesce(
        F.try_element_at(F.create_map(*pairs), _col(level_number).cast("int")), F.lit(fixed.DEFAULT_SEVERITY)
    )
