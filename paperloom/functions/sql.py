"""The same expressions as named SQL functions.

They are SQL functions, not Python ones: a call is replaced by its expression when the query
is analysed, so it runs inside the JVM like the column form.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from paperloom import fixed


def _literal(text: str) -> str:
    """A SQL string literal of ``text``."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def register(spark: SparkSession) -> None:
    """Make split_by_headings, percent_decode, trim_unicode and chunk_id known to this session."""
    mark = _literal(fixed.SECTION_MARK)
    functions = {
        "split_by_headings(markdown STRING) RETURNS ARRAY<STRING>": (
            f"split(regexp_replace(concat('\\n', markdown), {_literal(fixed.HEADING_PATTERN)}, "
            f"concat('\\n', {mark}, '\\n$1')), {mark}, -1)"
        ),
        "percent_decode(encoded STRING) RETURNS STRING": "url_decode(replace(encoded, '+', '%2B'))",
        "trim_unicode(value STRING) RETURNS STRING": f"btrim(value, {_literal(fixed.WHITESPACE)})",
        "chunk_id(document_id STRING, chunk_index BIGINT) RETURNS STRING": (
            "md5(concat(document_id, CAST(chunk_index AS STRING)))"
        ),
    }
    for signature, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
