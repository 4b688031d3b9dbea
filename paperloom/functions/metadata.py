"""Access to object metadata stored as ``array<struct<name, value>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import _col


def meta_value(metadata: Column | str, name: str) -> Column:
    """Value of the entry called ``name``; two entries of that name are an error."""
    found = F.filter(_col(metadata), lambda m: m["name"] == name)
    return F.when(
        F.size(found) > 1, F.raise_error(F.concat(F.lit(f"metadata has several values for {name}"))).cast("string")
    ).otherwise(F.get(found, 0)["value"])


def modified_or(metadata: Column | str, fallback: Column | str) -> Column:
    """Feed modification time when known, else the given time."""
    return F.coalesce(meta_value(metadata, "modified_gmt").cast("timestamp"), _col(fallback))


def stored_document_id(metadata: Column | str) -> Column:
    """Drive id first, media id second."""
    return F.coalesce(meta_value(metadata, "drive-file-id"), meta_value(metadata, "media-id"))
