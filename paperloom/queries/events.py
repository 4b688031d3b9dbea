"""Event extraction, calendar texts and the sync state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import dates
from paperloom.operators import marts
from paperloom.queries import base
from paperloom.queries.base import STAMP, query, table, with_ctes
from paperloom.sources import tables

AS_OF = "2024-01-15"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model result per event row: a good event, a more detailed twin, a bad date, a blank title."""
    e = base.spread(table(spark, sf_dir, "events"), "event_id")
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    day = F.date_format(F.col("ts"), "yyyy-M-d")
    clock = (
        F.when(F.col("event_id") % 5 == 0, F.lit("null"))
        .when(F.col("event_id") % 5 == 1, F.lit('"25:00"'))
        .otherwise(F.concat(F.lit('"'), F.date_format("ts", "H:mm"), F.lit('"')))
    )

    def item(date, time, title, text):
        return F.concat(
            F.lit('{"event_date": "'), date, F.lit('", "event_time": '), time, F.lit(', "event_title": "'), title,
            F.lit('", "event_description": "'), text, F.lit('"}'),
        )

    body = F.concat(
        F.lit('{"events": ['),
        item(day, clock, kind, F.concat(F.lit("user "), user)),
        F.lit(", "),
        item(day, clock, kind, F.concat(kind, F.lit("\\nby user "), user)),
        F.lit(", "),
        item(F.lit("2024-02-30"), clock, kind, user),
        F.lit(", "),
        item(day, clock, F.lit(" 　"), user),
        F.lit("]}"),
    )
    return e.select(
        F.concat(F.lit("doc-"), F.col("event_id").cast("string")).alias("document_id"), body.alias("llm_result")
    )


RESULTS = """
results AS (
  SELECT 'doc-' || event_id AS document_id,
         strftime(ts, '%Y-%-m-%-d') AS day,
         CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '25:00' ELSE strftime(ts, '%-H:%M') END AS clock,
         event_type, user_id, event_id AS src_id, ts
  FROM events)"""

EVENTS = """
fct_events AS (
  SELECT document_id, event_type AS event_title, event_type || chr(10) || 'by user ' || user_id AS event_description,
         md5(document_id || day || coalesce(clock, '') || event_type) AS event_id,
         CAST(ts AS DATE) AS event_date,
         CASE WHEN src_id % 5 > 1 THEN strftime(ts, '%H:%M') END AS event_time, src_id
  FROM results)"""


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.extract_events(results(spark, sf_dir), F.lit("2024-02-01").cast("timestamp"))


@query(
    "extract_events",
    with_ctes(
        RESULTS,
        EVENTS,
        select="""
SELECT document_id, event_title, event_description, event_id, strftime(event_date, '%Y-%m-%d') AS event_date, event_time,
       '2024-02-01T00:00:00Z' AS extracted_at FROM fct_events""",
    ),
)
def _extract(spark, sf):
    return (
        extracted(spark, sf)
        .withColumn("event_date", F.col("event_date").cast("string"))
        .withColumn("extracted_at", dates.utc_stamp("extracted_at"))
    )


def _documents(spark, sf):
    """Half of the event documents are known."""
    e = table(spark, sf, "events").where("value > 10")
    return e.select(
        F.concat(F.lit("doc-"), F.col("event_id").cast("string")).alias("document_id"),
        F.concat(F.lit("title of "), "event_type").alias("title"),
        F.col("event_type").alias("document_type"),
        F.to_date("ts").alias("publish_date"),
    )


def _history(spark, sf):
    """Events of some users were already copied to a calendar."""
    synced = extracted(spark, sf).where(F.col("event_description").endswith("7"))
    return synced.select(
        "event_id",
        F.concat(F.lit("cal-"), "event_id").alias("calendar_event_id"),
        F.lit("2024-01-20 03:04:05").cast("timestamp").alias("synced_at"),
        F.lit("someone").alias("synced_by"),
    )


SYNCED = f"""
docs AS (
  SELECT 'doc-' || event_id AS document_id, 'title of ' || event_type AS title, event_type AS document_type,
         CAST(ts AS DATE) AS publish_date FROM events WHERE value > 10),
history AS (
  SELECT event_id, 'cal-' || event_id AS calendar_event_id, TIMESTAMP '2024-01-20 03:04:05' AS synced_at
  FROM fct_events WHERE event_description LIKE '%7'),
synced AS (
  SELECT e.*, d.title AS document_title, d.document_type, d.publish_date, h.calendar_event_id, h.synced_at
  FROM fct_events e LEFT JOIN docs d ON e.document_id = d.document_id LEFT JOIN history h ON e.event_id = h.event_id
  WHERE e.event_date >= date_trunc('month', DATE '{AS_OF}')
    AND (e.event_date >= DATE '{AS_OF}' OR h.event_id IS NULL))"""


def synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.events_with_sync(
        extracted(spark, sf_dir), _documents(spark, sf_dir), _history(spark, sf_dir), AS_OF
    )


@query(
    "events_with_sync",
    with_ctes(
        RESULTS,
        EVENTS,
        SYNCED,
        select=f"""
SELECT event_id, document_id, strftime(event_date, '%Y-%m-%d') AS event_date, event_time, event_title, document_title,
       document_type, strftime(publish_date, '%Y-%m-%d') AS publish_date, calendar_event_id,
       strftime(synced_at, '{STAMP}') AS synced_at FROM synced""",
    ),
)
def _with_sync(spark, sf):
    return synced(spark, sf).select(
        "event_id",
        "document_id",
        F.col("event_date").cast("string").alias("event_date"),
        "event_time",
        "event_title",
        "document_title",
        "document_type",
        F.col("publish_date").cast("string").alias("publish_date"),
        "calendar_event_id",
        dates.utc_stamp("synced_at").alias("synced_at"),
    )


@query(
    "events_never_synced",
    with_ctes(
        RESULTS,
        EVENTS,
        select="""
SELECT event_id, strftime(event_date, '%Y-%m-%d') AS event_date, event_title, CAST(NULL AS VARCHAR) AS calendar_event_id
FROM fct_events WHERE event_date >= DATE '2024-01-01'""",
    ),
)
def _never_synced(spark, sf):
    """With an empty sync history every event of the month is open."""
    nothing = tables.empty_table(spark, tables.SYNC_HISTORY_SCHEMA)
    rows = marts.events_with_sync(extracted(spark, sf), _documents(spark, sf), nothing, AS_OF)
    return rows.select("event_id", F.col("event_date").cast("string").alias("event_date"), "event_title", "calendar_event_id")


@query(
    "upcoming_events",
    with_ctes(
        RESULTS,
        EVENTS,
        select=f"""
SELECT event_id, strftime(event_date, '%Y-%m-%d') AS event_date, event_time, event_title,
       strftime(event_date, '%Y年%-m月%-d日') AS date_label
FROM fct_events WHERE event_date >= DATE '{AS_OF}'""",
    ),
)
def _upcoming(spark, sf):
    rows = marts.upcoming_events(extracted(spark, sf), AS_OF)
    return rows.select(
        "event_id",
        F.col("event_date").cast("string").alias("event_date"),
        "event_time",
        "event_title",
        dates.date_label("event_date").alias("date_label"),
    )


_PLUS_HOUR = "strftime(CAST(event_date AS TIMESTAMP) + CAST(event_time AS TIME)::INTERVAL + INTERVAL 1 HOUR, '%H%M')"

ICAL = f"""
ical AS (
  SELECT *, concat_ws(chr(10), 'BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//paperloom//EN', 'CALSCALE:GREGORIAN', 'BEGIN:VEVENT',
    'UID:' || event_id || '@paperloom', 'SUMMARY:' || event_title,
    'DESCRIPTION:' || replace(event_description, chr(10), '\\n'),
    CASE WHEN event_time IS NOT NULL THEN
      'DTSTART;TZID=Asia/Tokyo:' || strftime(event_date, '%Y%m%d') || 'T' || replace(event_time, ':', '') || '00' || chr(10) ||
      'DTEND;TZID=Asia/Tokyo:' || strftime(event_date, '%Y%m%d') || 'T'
        || printf('%02d', (CAST(left(event_time, 2) AS INTEGER) + 1) % 24) || right(event_time, 2) || '00'
    ELSE 'DTSTART;VALUE=DATE:' || strftime(event_date, '%Y%m%d') || chr(10) ||
         'DTEND;VALUE=DATE:' || strftime(event_date + 1, '%Y%m%d') END,
    'END:VEVENT', 'END:VCALENDAR') AS ical_content FROM synced)"""


@query(
    "ical_text",
    with_ctes(RESULTS, EVENTS, SYNCED, ICAL, select="SELECT event_id, ical_content FROM ical"),
)
def _ical(spark, sf):
    return synced(spark, sf).select("event_id", marts.ical_text().alias("ical_content"))


@query(
    "calendar_link",
    with_ctes(
        RESULTS,
        EVENTS,
        """parts AS (
  SELECT event_id, event_title, event_description, strftime(event_date, '%Y%m%d') AS day,
         strftime(event_date + 1, '%Y%m%d') AS next_day, event_time,
         printf('%02d', (CAST(left(event_time, 2) AS INTEGER) + 1) % 24) || right(event_time, 2) AS stop
  FROM fct_events)""",
        select="""
SELECT event_id, 'https://calendar.google.com/calendar/render?action=TEMPLATE&text=' || event_title || '&dates='
  || CASE WHEN event_time IS NOT NULL THEN day || 'T' || replace(event_time, ':', '') || '00%2F' || day || 'T' || stop || '00'
          ELSE day || '%2F' || next_day END
  || '&details=' || replace(url_encode(event_description), '%20', '+') || '&ctz=Asia%2FTokyo' AS link
FROM parts""",
    ),
)
def _link(spark, sf):
    return extracted(spark, sf).select("event_id", marts.calendar_link().alias("link"))


@query(
    "export_events",
    with_ctes(
        RESULTS,
        EVENTS,
        SYNCED,
        ICAL,
        select=f"""
SELECT event_id, document_id, event_title, event_description, document_title, calendar_event_id,
       strftime(event_date, '%Y-%m-%d') AS event_date, event_time, strftime(synced_at, '{STAMP}') AS synced_at, ical_content
FROM ical""",
    ),
)
def _export_events(spark, sf):
    return marts.export_events(synced(spark, sf))
