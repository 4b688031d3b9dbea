"""Document, chunk and event tables and their read-side projections."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom import fixed
from paperloom.functions import dates, json
from paperloom.functions.metadata import meta_value, modified_or, stored_document_id
from paperloom.functions.text import (
    let,
    byte_size_label,
    form_encode,
    last_segment,
    md5_id,
    not_blank,
    percent_decode,
    type_label,
)
from paperloom.operators.relational import top_per_group


# --- staging ---------------------------------------------------------------------------


def stage_texts(generated: DataFrame, result: str = "llm_result", status: str = "status") -> DataFrame:
    """Typed projection of extraction results; failed and empty results are dropped."""
    ok = json.expand(generated.where(F.col(status) == ""), json.scalars(result, ["extracted_markdown"]))
    return (
        ok.where("extracted_markdown is not null")
        .select(
            "uri",
            stored_document_id("metadata").alias("document_id"),
            percent_decode(meta_value("metadata", "original-filename")).alias("original_filename"),
            "extracted_markdown",
            F.col(result).alias("llm_result"),
            F.col(status).alias("status"),
            "content_type",
            "size",
            "md5_hash",
            modified_or("metadata", "updated").alias("updated_at"),
        )
    )


# --- documents -------------------------------------------------------------------------


def document_dimension(chunks: DataFrame, staged: DataFrame) -> DataFrame:
    """One row per document with its title and roll-ups, before classification.

    Chunks are counted first, so the join for the file name moves one row per document and
    not one per chunk. The text columns are grouping keys of the first step because a
    maximum over strings cannot be hash-aggregated and would sort all chunks; a second,
    small step takes their maximum.
    """
    own = ["document_id", "uri"]
    counted = chunks.groupBy(*own, "content_type", "md5_hash").agg(
        F.count("*").alias("total_chunks"), F.max("size").alias("size"), F.max("updated_at").alias("updated_at")
    )
    rolled = counted.groupBy(*own).agg(
        F.sum("total_chunks").alias("total_chunks"),
        F.max("content_type").alias("content_type"),
        F.max("size").alias("size"),
        F.max("md5_hash").alias("md5_hash"),
        F.max("updated_at").alias("updated_at"),
    )
    names = staged.select("uri", "original_filename")
    return rolled.join(names, "uri", "left").select(
        "document_id",
        "uri",
        F.coalesce("original_filename", last_segment("uri")).alias("title"),
        "total_chunks",
        "content_type",
        "size",
        "md5_hash",
        "updated_at",
    )


def denormalise_chunks(embedded: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with the title, type and date of their document, for join-free search."""
    dim = documents.select("document_id", "title", "document_type", "publish_date")
    own = [c for c in ("chunk_id", "document_id", "chunk_index", "chunk_text", "chunk_embedding") if c in embedded.columns]
    return embedded.select(*own).join(dim, "document_id", "inner").select(
        *own, "title", "document_type", "publish_date"
    )


def document_detail(documents: DataFrame, chunks: DataFrame, part_size: int | None = None) -> DataFrame:
    """Documents with their chunks nested in index order, one row each.

    With ``part_size`` a document of more chunks continues in further rows (``part`` 1, 2, ...),
    for readers that want rows of bounded size.
    """
    cols = ["chunk_id", "chunk_index", "chunk_text"]
    part = F.floor(F.col("chunk_index") / part_size) if part_size else F.lit(0).cast("long")
    nested = (
        chunks.withColumn("part", part)
        .groupBy("document_id", "part")
        .agg(F.sort_array(F.collect_list(F.struct("chunk_index", *[c for c in cols if c != "chunk_index"]))).alias("chunks"))
    )
    empty = F.array().cast(nested.schema["chunks"].dataType)
    return (
        documents.join(nested, "document_id", "left")
        .withColumn("part", F.coalesce("part", F.lit(0).cast("long")))
        .withColumn("chunks", F.coalesce("chunks", empty))
    )


def list_recent(raw: DataFrame, limit: int = fixed.LIST_LIMIT) -> DataFrame:
    """Newest objects as strings, ties by uri."""
    return (
        raw.orderBy(F.col("updated").desc(), "uri")
        .limit(limit)
        .select(
            "uri",
            F.col("generation").cast("string").alias("generation"),
            "content_type",
            "size",
            dates.utc_stamp("updated").alias("updated"),
        )
    )


def list_page(
    documents: DataFrame,
    document_type: str | None = None,
    start: dt.date | str | None = None,
    end: dt.date | str | None = None,
    offset: int = 0,
    limit: int = fixed.PAGE_LIMIT,
) -> DataFrame:
    """One page of the listing, newest publish date first."""
    rows = documents
    if document_type is not None:
        rows = rows.where(F.col("document_type") == document_type)
    if start is not None:
        rows = rows.where(F.col("publish_date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("publish_date") <= F.lit(end).cast("date"))
    return rows.orderBy(F.col("publish_date").desc_nulls_last(), "document_id").offset(offset).limit(limit)


def list_after(
    documents: DataFrame,
    after: tuple[dt.date | str | None, str] | None = None,
    document_type: str | None = None,
    start: dt.date | str | None = None,
    end: dt.date | str | None = None,
    limit: int = fixed.PAGE_LIMIT,
) -> DataFrame:
    """The page that follows the row of ``after`` = (publish_date, document_id); None is the first.

    Same order and pages as ``list_page``, but the rows before are filtered out in the scan, by
    their date already where the table is kept by date, in place of being sorted and skipped.
    """
    rows = documents
    if after is not None:
        day, last = after
        undated = F.col("publish_date").isNull()
        if day is None:
            rows = rows.where(undated & (F.col("document_id") > last))
        else:
            at = F.lit(day).cast("date")
            rows = rows.where(undated | (F.col("publish_date") <= at))
            rows = rows.where(undated | (F.col("publish_date") < at) | (F.col("document_id") > last))
    return list_page(rows, document_type, start, end, limit=limit)


def sort_documents(documents: DataFrame, document_type: str | None = None) -> DataFrame:
    """Publish date descending with undated last; undated ones by update time."""
    rows = documents if document_type is None else documents.where(F.col("document_type") == document_type)
    undated = F.when(F.col("publish_date").isNull(), F.col("updated_at"))
    return rows.orderBy(F.col("publish_date").desc_nulls_last(), undated.desc_nulls_last(), "document_id")


def facet(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-empty values."""
    return df.where(F.col(column).isNotNull() & (F.col(column) != "")).select(column).distinct().orderBy(column)


def with_type_label(documents: DataFrame, rules: DataFrame) -> DataFrame:
    """Label of the document type from the rule table, the code itself when it has none."""
    labels = rules.select(F.col("document_type").alias("_type"), "label_ja")
    joined = documents.join(labels, F.col("document_type") == F.col("_type"), "left")
    return joined.withColumn("type_label", F.coalesce("label_ja", "document_type")).drop("_type", "label_ja")


def document_cards(documents: DataFrame) -> DataFrame:
    """Listing labels: type label, readable size, Japanese date (update time when undated)."""
    return documents.select(
        "document_id",
        "title",
        type_label("document_type").alias("type_label"),
        byte_size_label("size").alias("size_label"),
        dates.date_label(F.coalesce("publish_date", F.to_date("updated_at"))).alias("date_label"),
        "total_chunks",
    )


# --- events ----------------------------------------------------------------------------


def event_items(result: Column | str) -> Column:
    """Events of a model result: array of structs of strings, NULL without an event array."""
    return json.objects(result, "events", ["event_date", "event_time", "event_title", "event_description"])


def _longest_items(items: Column) -> Column:
    """The valid items of one result, sorted, of items alike in date, clock and title the one of
    the longest description (ties by the description, null last)."""
    valid = F.filter(items, lambda e: dates.safe_date(e["event_date"]).isNotNull() & not_blank(e["event_title"]))

    def keyed(e: Column) -> Column:
        text = e["event_description"]
        return F.struct(
            F.struct(e["event_date"].alias("date"), F.coalesce(e["event_time"], F.lit("")).alias("clock"), e["event_title"].alias("title")).alias("key"),
            (-F.coalesce(F.length(text), F.lit(-1))).alias("shorter"),
            text.alias("event_description"),
            e["event_time"].alias("event_time"),
        )

    def first(rows: Column) -> Column:
        return F.filter(rows, lambda e, i: ~e["key"].eqNullSafe(F.get(rows, i - 1)["key"]))

    return let(F.array_sort(F.transform(valid, keyed)), first)


def extract_events(generated: DataFrame, extracted_at: Column, result: str = "llm_result", unique_ids: bool = False) -> DataFrame:
    """Typed events out of model results, the most detailed of equal events kept.

    Equal events of one result are settled inside its array, before it is exploded. With
    ``unique_ids``, which says that a document has one result, that is all and nothing is
    shuffled; otherwise what is left of several results meets by document, date, clock and title.
    """
    events = generated.select("document_id", F.explode(_longest_items(event_items(result))).alias("e"))
    longest = events.select(
        "document_id",
        F.col("e.key.date").alias("event_date_str"),
        F.col("e.event_time").alias("event_time_str"),
        F.col("e.key.clock").alias("clock"),
        F.col("e.key.title").alias("event_title"),
        "e.event_description",
    )
    if not unique_ids:
        longest = top_per_group(
            longest,
            ["document_id", "event_date_str", "clock", "event_title"],
            [F.length("event_description").desc_nulls_last(), F.col("event_description").asc_nulls_last()],
        )
    return longest.select(
        "document_id",
        "event_title",
        "event_description",
        md5_id("document_id", "event_date_str", "clock", "event_title").alias("event_id"),
        dates.safe_date("event_date_str").alias("event_date"),
        dates.safe_clock("event_time_str").alias("event_time"),
        extracted_at.alias("extracted_at"),
    )


def events_with_sync(events: DataFrame, documents: DataFrame, history: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Events from the month of ``as_of`` on; past ones only while never synced."""
    today = F.lit(as_of).cast("date")
    recent = events.where(F.col("event_date") >= F.trunc(today, "MM"))
    dim = documents.select("document_id", F.col("title").alias("document_title"), "document_type", "publish_date")
    synced = history.select("event_id", "calendar_event_id", "synced_at", F.lit(True).alias("_synced"))
    return (
        recent.join(synced, "event_id", "left")
        .where((F.col("event_date") >= today) | F.col("_synced").isNull())
        .join(dim, "document_id", "left")
        .select(
            "event_id",
            "document_id",
            "event_date",
            "event_time",
            "event_title",
            "event_description",
            "extracted_at",
            "document_title",
            "document_type",
            "publish_date",
            "calendar_event_id",
            "synced_at",
        )
    )


def upcoming_events(events: DataFrame, as_of: dt.date | str) -> DataFrame:
    """From ``as_of`` on, by date, then time with untimed events last."""
    return events.where(F.col("event_date") >= F.lit(as_of).cast("date")).orderBy(
        "event_date", dates.clock_sort_key("event_time"), "event_id"
    )


def ical_text(product: str = "-//paperloom//EN", domain: str = "paperloom") -> Column:
    """Calendar text of an event row.

    Timed events last an hour on the same date (23:30 ends at 00:30 of that date, as the
    calendar feed has always written it); untimed ones are whole days.
    """
    day = dates.compact_date("event_date")

    def at(clock: Column) -> Column:
        return F.concat(day, F.lit("T"), F.replace(clock, F.lit(":"), F.lit("")), F.lit("00\n"))

    zone = f";TZID={fixed.CALENDAR_ZONE}:"
    timed = F.concat(
        F.lit("DTSTART" + zone),
        at(F.col("event_time")),
        F.lit("DTEND" + zone),
        at(dates.add_minutes("event_time", fixed.EVENT_MINUTES)),
    )
    whole_day = F.concat(
        F.lit("DTSTART;VALUE=DATE:"),
        day,
        F.lit("\nDTEND;VALUE=DATE:"),
        dates.compact_date(F.date_add("event_date", 1)),
        F.lit("\n"),
    )
    return F.concat(
        F.lit(f"BEGIN:VCALENDAR\nVERSION:2.0\nPRODID:{product}\nCALSCALE:GREGORIAN\nBEGIN:VEVENT\nUID:"),
        F.col("event_id"),
        F.lit(f"@{domain}\nSUMMARY:"),
        F.coalesce("event_title", F.lit("")),
        F.lit("\nDESCRIPTION:"),
        F.replace(F.coalesce("event_description", F.lit("")), F.lit("\n"), F.lit("\\n")),
        F.lit("\n"),
        F.when(F.col("event_time").isNotNull(), timed).otherwise(whole_day),
        F.lit("END:VEVENT\nEND:VCALENDAR"),
    )


def calendar_link() -> Column:
    """Template URL that opens the event in a web calendar."""
    day = dates.compact_date("event_date")
    digits = F.replace("event_time", F.lit(":"), F.lit(""))
    stop = F.replace(dates.add_minutes("event_time", fixed.EVENT_MINUTES), F.lit(":"), F.lit(""))
    timed = F.concat(day, F.lit("T"), digits, F.lit("00/"), day, F.lit("T"), stop, F.lit("00"))
    whole_day = F.concat(day, F.lit("/"), dates.compact_date(F.date_add("event_date", 1)))
    span = F.when(F.col("event_time").isNotNull(), timed).otherwise(whole_day)
    return F.concat(
        F.lit(fixed.CALENDAR_LINK + "action=TEMPLATE&text="),
        form_encode("event_title"),
        F.lit("&dates="),
        form_encode(span),
        F.lit("&details="),
        form_encode("event_description"),
        F.lit("&ctz="),
        form_encode(F.lit(fixed.CALENDAR_ZONE)),
    )


# --- exports ---------------------------------------------------------------------------

DOCUMENT_EXPORT = (
    "document_id",
    "uri",
    "title",
    "document_type",
    "publish_date",
    "content_type",
    "size",
    "total_chunks",
    "updated_at",
)
CHUNK_EXPORT = ("chunk_id", "document_id", "chunk_index", "chunk_text", "title", "document_type", "publish_date")
EVENT_EXPORT = (
    "event_id",
    "document_id",
    "event_title",
    "event_description",
    "document_title",
    "calendar_event_id",
    "event_date",
    "event_time",
    "synced_at",
    "ical_content",
)


def export_documents(documents: DataFrame) -> DataFrame:
    text_date = documents.withColumn("publish_date", F.col("publish_date").cast("string"))
    # The id spreads documents of one time over the sort's partitions.
    return text_date.select(*DOCUMENT_EXPORT).orderBy(F.col("updated_at").desc(), "document_id")


def export_chunks(chunks: DataFrame) -> DataFrame:
    text_date = chunks.withColumn("publish_date", F.col("publish_date").cast("string"))
    # Each shard is in order; the order of the shards is no part of the contract.
    return text_date.select(*CHUNK_EXPORT).sortWithinPartitions("document_id", "chunk_index")


def export_events(events: DataFrame, **calendar) -> DataFrame:
    rows = events.withColumn("ical_content", ical_text(**calendar))
    rows = rows.withColumn("event_date", F.date_format("event_date", "yyyy-MM-dd"))
    return rows.withColumn("synced_at", dates.utc_stamp("synced_at")).select(*EVENT_EXPORT)
