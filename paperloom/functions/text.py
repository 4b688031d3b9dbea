"""String column expressions. All run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom import fixed

_WS_CLASS = "[" + "".join(f"\\u{ord(c):04x}" for c in fixed.WHITESPACE) + "]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside a lambda expression.

    Lambda bodies get no common-subexpression elimination, so repeating an expensive
    expression there would evaluate it again each time.
    """
    return F.transform(F.array(value), body).getItem(0)


def ws_trim(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(fixed.WHITESPACE))


def ws_ltrim(c: Column | str) -> Column:
    return F.ltrim(_col(c), F.lit(fixed.WHITESPACE))


def not_blank(c: Column | str) -> Column:
    return ws_trim(c) != ""


def literal_split(c: Column | str, separator: str) -> Column:
    return F.split(_col(c), re.escape(separator), -1)


def normalize_newlines(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit("\r\n"), F.lit("\n"))


def tokens(c: Column | str) -> Column:
    """Split on runs of Unicode whitespace, without empty tokens."""
    return F.filter(F.split(_col(c), _WS_CLASS + "+", -1), lambda t: t != "")


def like_pattern(c: Column | str) -> Column:
    """A keyword as a LIKE pattern: ``%`` and ``_`` are wildcards, a backslash before them or
    before another one escapes, and any other backslash is itself."""
    return F.regexp_replace(_col(c), r"\G((?:[^\\]|\\[%_\\])*+)\\", r"$1\\\\")


def like_any(c: Column | str, keywords: Sequence[str]) -> Column:
    """OR over ``%keyword%``; wildcards inside a keyword keep their meaning."""
    if not keywords:
        return F.lit(False)
    patterns = [re.sub(r"(\\[%_\\])|\\", lambda m: m[1] or "\\\\", k) for k in keywords]
    return reduce(lambda a, b: a | b, [_col(c).like(f"%{p}%") for p in patterns])


def decode_entities(c: Column | str) -> Column:
    for entity, char in fixed.ENTITIES:
        c = F.replace(_col(c), F.lit(entity), F.lit(char))
    return c


def safe_file_name(c: Column | str) -> Column:
    return F.translate(decode_entities(c), fixed.FORBIDDEN_IN_NAMES, "")


def last_segment(c: Column | str) -> Column:
    """Text after the last slash, NULL when there is none."""
    return F.nullif(F.regexp_extract(_col(c), r"/([^/]+)$", 1), F.lit(""))


def uri_bucket(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(c), r"^gs://([^/]+)/(.+)$", 1), F.lit(""))


def uri_key(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(c), r"^gs://([^/]+)/(.+)$", 2), F.lit(""))


def percent_decode(c: Column | str, strict: bool = True) -> Column:
    """Percent decoding that leaves ``+`` alone; malformed input raises unless ``strict=False``."""
    kept = F.replace(_col(c), F.lit("+"), F.lit("%2B"))
    return F.url_decode(kept) if strict else F.try_url_decode(kept)


def form_encode(c: Column | str) -> Column:
    """Query-string encoding: space becomes ``+``."""
    return F.url_encode(_col(c))


def percent_encode(c: Column | str) -> Column:
    """Component encoding: space becomes ``%20`` and ``!'()~`` stay as they are."""
    out = form_encode(c)
    for coded, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(coded), F.lit(char))
    return out


def original_filename(url: Column | str) -> Column:
    """Percent-encoded last path segment, the same for raw and already-encoded URLs."""
    return percent_encode(percent_decode(F.element_at(F.split(_col(url), "/", -1), -1)))


def byte_size_label(c: Column | str) -> Column:
    c = _col(c)

    def one_decimal(unit: int) -> Column:
        return (c.cast("double") / unit).cast("decimal(30,1)").cast("string")

    return (
        F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
        .when(c < 1024 * 1024, F.concat(one_decimal(1024), F.lit(" KB")))
        .otherwise(F.concat(one_decimal(1024 * 1024), F.lit(" MB")))
    )


def type_label(c: Column | str, labels: dict[str, str] | None = None) -> Column:
    """Label of a code, the code itself when it has none."""
    labels = fixed.DOCUMENT_TYPE_LABELS if labels is None else labels
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _col(c)), _col(c)) if pairs else _col(c)


def md5_id(*parts: Column | str, separator: str = "") -> Column:
    """Hex MD5 of the concatenation; any NULL part makes the id NULL."""
    texts = [_col(p).cast("string") for p in parts]
    if separator:
        texts = [x for t in texts for x in (F.lit(separator), t)][1:]
    return F.md5(F.concat(*texts))


def random_id() -> Column:
    """A random UUID per row."""
    return F.uuid()
