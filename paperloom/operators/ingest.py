"""Selecting what to ingest from a media feed: letters (posts) and their attachments."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.metadata import meta_value
from paperloom.functions.text import _col, original_filename, safe_file_name
from paperloom.operators.relational import top_per_group
from paperloom.sources.state import new_objects


def modified_after(df: DataFrame, since: dt.datetime | str, column: str = "modified") -> DataFrame:
    """Posts modified after ``since``, newest first."""
    return df.where(F.col(column) > F.lit(since).cast("timestamp")).orderBy(F.col(column).desc(), "id")


def attachments(letters: DataFrame, media: DataFrame, mime_type: str = "application/pdf") -> DataFrame:
    """Media of the given letters and type."""
    wanted = media.where(F.col("mime_type") == mime_type)
    posts = letters.select(F.col("id").alias("post"))
    return wanted.join(posts, "post", "left_semi")


def latest_attachment(media: DataFrame) -> DataFrame:
    """Newest attachment per post; equal times keep the lower id."""
    return top_per_group(media, ["post"], [F.col("modified_gmt").desc(), F.col("id").asc()])


def dedupe_titles(media: DataFrame) -> DataFrame:
    """Newest attachment per (post, cleaned title)."""
    named = media.withColumn("_title", safe_file_name("title"))
    return top_per_group(named, ["post", "_title"], [F.col("modified_gmt").desc(), F.col("id").asc()]).drop("_title")


def object_path(
    id_col: Column | str = "id", date: Column | str = "date", title: Column | str = "title"
) -> Column:
    """``web/YYYY/MM/{id}_{title}.pdf`` by the UTC date of the media."""
    return F.concat(
        F.lit("web/"),
        F.date_format(_col(date), "yyyy/MM/"),
        _col(id_col).cast("string"),
        F.lit("_"),
        safe_file_name(title),
        F.lit(".pdf"),
    )


def object_metadata() -> Column:
    """The five metadata entries written with an upload: array<struct<name, value>>."""
    entries = (
        ("original-filename", original_filename("source_url")),
        ("source-url", F.col("source_url")),
        ("letter-id", F.col("post").cast("string")),
        ("media-id", F.col("id").cast("string")),
        ("modified_gmt", F.date_format("modified_gmt", "yyyy-MM-dd'T'HH:mm:ss")),
    )
    return F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in entries])


def metadata_backfill(objects: DataFrame, media: DataFrame) -> DataFrame:
    """Objects with the status of the back-fill and, when patched, the feed time.

    Objects without a media id or with a known time never enter the join, so their shared
    NULL key cannot pile up on one task.
    """
    tagged = objects.withColumn("_media", F.nullif(meta_value("metadata", "media-id"), F.lit(""))).withColumn(
        "_known", F.nullif(meta_value("metadata", "modified_gmt"), F.lit(""))
    )
    open_rows = F.col("_media").isNotNull() & F.col("_known").isNull()
    feed = media.select(
        F.col("id").cast("string").alias("_media"),
        F.date_format("modified_gmt", "yyyy-MM-dd'T'HH:mm:ss").alias("modified_gmt"),
    )
    patched = (
        tagged.where(open_rows)
        .join(feed, "_media", "left")
        .withColumn("outcome", F.when(F.col("modified_gmt").isNotNull(), F.lit("uploaded")).otherwise(F.lit("error")))
    )
    skipped = (
        tagged.where(~open_rows)
        .withColumn("modified_gmt", F.lit(None).cast("string"))
        .withColumn("outcome", F.lit("skipped"))
    )
    return patched.unionByName(skipped).drop("_media", "_known")


def apply_backfill(patched: DataFrame) -> DataFrame:
    """Metadata arrays with the new ``modified_gmt`` entry added where one was found."""
    entry = F.struct(F.lit("modified_gmt").alias("name"), F.col("modified_gmt").alias("value"))
    grown = F.when(F.col("modified_gmt").isNotNull(), F.concat("metadata", F.array(entry))).otherwise(F.col("metadata"))
    return patched.withColumn("metadata", grown).drop("modified_gmt", "outcome")


def outcome_counts(results: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Run summary over upload or back-fill results."""
    c = F.col(outcome)
    return results.agg(
        F.count_if(c == "uploaded").alias("uploaded"),
        F.count_if(c == "skipped").alias("skipped"),
        F.count_if(c == "error").alias("errors"),
        F.count("*").alias("total"),
    )


def upload_outcome(skipped: Column | str = "skipped", error: Column | str = "error") -> Column:
    """Outcome name of an upload result (skipped flag, optional error flag)."""
    failed = F.coalesce(_col(error), F.lit(False))
    return F.when(_col(skipped), F.lit("skipped")).when(failed, F.lit("error")).otherwise(F.lit("uploaded"))


def ingest_plan(
    letters: DataFrame, media: DataFrame, stored: DataFrame, since: dt.datetime | str, per_title: bool = False
) -> DataFrame:
    """What to upload: newest attachment of every recently modified letter not stored yet.

    ``per_title`` keeps the newest of each differently titled attachment instead of one per
    letter. ``stored`` has ``object_path``.
    """
    recent = letters.where(F.col("modified") > F.lit(since).cast("timestamp"))
    found = attachments(recent, media)
    chosen = dedupe_titles(found) if per_title else latest_attachment(found)
    planned = chosen.withColumn("object_path", object_path()).withColumn("metadata", object_metadata())
    return new_objects(planned, stored).select("id", "post", "source_url", "object_path", "metadata")
