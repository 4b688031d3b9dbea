"""Side-by-side comparison of two inference runs ``a`` and ``b`` (document_id, result)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom import fixed
from paperloom.functions import dates, json
from paperloom.functions.text import let
from paperloom.operators.marts import event_items


def _side(df: DataFrame, key: str, result: str, side: str, names: list[str]) -> DataFrame:
    """Key and the named result fields, prefixed with the side."""
    rows = json.expand(df.select(F.col(key), F.col(result).alias("_result")), json.scalars("_result", names))
    return rows.select(key, *[F.col(n).alias(f"{side}_{n}") for n in names])


def compare_classification(a: DataFrame, b: DataFrame, sample: DataFrame | None = None, result: str = "llm_result") -> DataFrame:
    """Types and dates of both runs per document, disagreements first."""
    names = ["document_type", "publish_date"]
    rows = _side(a, "document_id", result, "a", names).join(_side(b, "document_id", result, "b", names), "document_id")
    if sample is not None:
        rows = sample.join(rows, "document_id")
    extra = [] if sample is None else [c for c in sample.columns if c != "document_id"]
    return (
        rows.select(
            "document_id",
            *extra,
            F.col("a_document_type").alias("a_type"),
            F.col("a_publish_date").alias("a_date"),
            F.col("b_document_type").alias("b_type"),
            F.col("b_publish_date").alias("b_date"),
        )
        .withColumn("type_match", F.col("a_type") == F.col("b_type"))
        .orderBy(F.col("type_match").asc_nulls_first(), "document_id")
    )


def classification_agreement(compared: DataFrame, minimum: float = fixed.AGREEMENT_MIN) -> DataFrame:
    matched = F.count_if(F.col("type_match"))
    return compared.agg(F.count("*").alias("n_documents"), matched.alias("n_matching")).select(
        "n_documents",
        "n_matching",
        (F.col("n_matching") / F.nullif("n_documents", F.lit(0))).alias("agreement"),
        (F.col("n_matching") / F.nullif("n_documents", F.lit(0)) >= minimum).alias("accepted"),
    )


def compare_text_length(
    a: DataFrame,
    b: DataFrame,
    key: str = "uri",
    result: str = "llm_result",
    status: str = "status",
    limit: float = fixed.LENGTH_DIFF_MAX,
    preview: int = fixed.PREVIEW_CHARS,
) -> DataFrame:
    """Relative length difference of extracted texts; a zero length gives NULL."""
    names = ["extracted_markdown"]
    left = _side(a.where(F.col(status) == ""), key, result, "a", names)
    right = _side(b.where(F.col(status) == ""), key, result, "b", names)
    texts = left.join(right, key).select(
        key, F.col("a_extracted_markdown").alias("a_text"), F.col("b_extracted_markdown").alias("b_text")
    )
    ratio = F.abs(F.length("a_text") - F.length("b_text")) / F.nullif(F.length("a_text"), F.lit(0))
    return texts.select(
        key,
        F.length("a_text").alias("a_len"),
        F.length("b_text").alias("b_len"),
        F.round(ratio, 3).alias("length_diff_ratio"),
        (ratio < limit).alias("length_ok"),
        F.left("a_text", F.lit(preview)).alias("a_preview"),
        F.left("b_text", F.lit(preview)).alias("b_preview"),
    ).orderBy(F.col("length_diff_ratio").desc_nulls_last(), key)


def event_counts(df: DataFrame, side: str, result: str = "llm_result") -> DataFrame:
    """Events and valid dates per (document, raw result); results without events vanish.

    Both counts come from the array inside the row, so nothing is exploded.
    """

    def counted(events: Column) -> Column:
        valid = F.filter(events, lambda e: dates.safe_date(e["event_date"]).isNotNull())
        return F.struct(F.size(events).alias("n"), F.size(valid).alias("v"))

    rows = json.expand(
        df.select("document_id", F.col(result).alias(f"{side}_raw")), let(event_items(F.col(f"{side}_raw")), counted)
    )
    return (
        rows.where("n > 0")
        .groupBy("document_id", F.md5(f"{side}_raw").alias("_raw"))
        .agg(
            F.any_value(f"{side}_raw").alias(f"{side}_raw"),
            F.max("n").cast("long").alias(f"{side}_event_count"),
            F.sum("v").alias(f"{side}_valid_dates"),
        )
        .drop("_raw")
    )


def compare_events(a: DataFrame, b: DataFrame, result: str = "llm_result", limit: int = fixed.EVENT_DIFF_MAX) -> DataFrame:
    rows = event_counts(a, "a", result).join(event_counts(b, "b", result), "document_id")
    diff = F.abs(F.col("a_event_count") - F.col("b_event_count"))
    return rows.select(
        "document_id",
        "a_event_count",
        "b_event_count",
        diff.alias("count_diff"),
        "a_valid_dates",
        "b_valid_dates",
        (diff <= limit).alias("count_ok"),
        (F.col("b_valid_dates") == F.col("b_event_count")).alias("all_dates_valid"),
        "a_raw",
        "b_raw",
    ).orderBy(F.col("count_diff").desc(), "document_id")


def sample_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """``LIMIT n`` sample, made repeatable by an order."""
    return df.orderBy(*order).limit(n)
