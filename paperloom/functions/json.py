"""JSON column expressions with scalar-or-NULL semantics.

Text is parsed once into string fields. A field that looks like an object or an array may
be one, or a string that starts that way; only such values are looked up a second time as
VARIANT, which knows the difference.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import _col, let


def parse(c: Column | str) -> Column:
    """Text to VARIANT, NULL when malformed."""
    return F.try_parse_json(_col(c))


def scalar(v: Column | str, path: str) -> Column:
    """Scalar of a VARIANT as text; NULL for objects, arrays, JSON null and absent paths."""
    v = _col(v)
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(~kind.rlike("^(OBJECT|ARRAY)"), F.try_variant_get(v, path, "string"))


def items(v: Column | str, path: str) -> Column:
    """Array at ``path`` as ``array<variant>``, NULL when it is no array."""
    return F.try_variant_get(_col(v), path, "array<variant>")


def _looks_nested(value: Column) -> Column:
    return value.startswith("{") | value.startswith("[")


def _strings(names: Sequence[str]) -> str:
    return ", ".join(f"{n}: string" for n in names)


def scalars(text: Column | str, names: Sequence[str]) -> Column:
    """Top-level scalars of a JSON object: struct of strings; all NULL when malformed."""
    text = _col(text)

    def guard(p: Column) -> Column:
        return F.struct(
            *[F.when(_looks_nested(p[n]), scalar(parse(text), f"$.{n}")).otherwise(p[n]).alias(n) for n in names]
        )

    return let(F.from_json(text, f"struct<{_strings(names)}>"), guard)


def objects(text: Column | str, name: str, names: Sequence[str]) -> Column:
    """The array under ``name`` as array<struct of strings>; NULL when there is none."""
    text = _col(text)

    def exact() -> Column:
        return F.transform(
            items(parse(text), f"$.{name}"), lambda e: F.struct(*[scalar(e, f"$.{n}").alias(n) for n in names])
        )

    def guard(found: Column) -> Column:
        doubtful = found.isNull() | F.exists(
            found, lambda e: F.coalesce(*[F.when(_looks_nested(e[n]), F.lit(True)) for n in names], F.lit(False))
        )
        return F.when(doubtful, exact()).otherwise(found)

    parsed = F.from_json(text, f"struct<{name}: array<struct<{_strings(names)}>>>")
    return let(parsed[name], guard)


def expand(df: DataFrame, fields: Column) -> DataFrame:
    """Add the fields of a struct expression as columns.

    Through a generator the expression is evaluated once per row; selected field by field,
    the optimizer may repeat it for every field and every filter on one.
    """
    return df.select("*", F.inline(F.array(fields)))
