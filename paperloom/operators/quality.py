"""Data-quality checks. A check returns failing rows; no rows means it passed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_rows(df: DataFrame, column: str, where: Column | str | None = None) -> DataFrame:
    rows = df if where is None else df.where(where)
    return rows.where(F.col(column).isNull())


def duplicate_keys(df: DataFrame, keys: Sequence[str], top: int | None = None) -> DataFrame:
    """Keys met more than once, NULL keys aside; ``top`` gives the worst offenders only."""
    present = df
    for k in keys:
        present = present.where(F.col(k).isNotNull())
    found = present.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    if top is None:
        return found
    return found.orderBy(F.col("n_rows").desc(), *keys).limit(top)


def orphan_keys(
    child: DataFrame, column: str, parent: DataFrame, parent_column: str, where: Column | str | None = None
) -> DataFrame:
    """Non-null child keys without a parent, with their row counts.

    Child keys are counted before the join, so a key owning a third of the rows joins once.
    """
    rows = child if where is None else child.where(where)
    keys = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n_rows"))
    known = parent.select(F.col(parent_column).alias("_parent"))
    return keys.join(known, F.col(column) == F.col("_parent"), "left_anti")


def unaccepted_values(df: DataFrame, column: str, accepted: Sequence) -> DataFrame:
    found = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*accepted))
    return found.groupBy(column).agg(F.count("*").alias("n_rows"))


def differing_rows(df: DataFrame, expected: str, actual: str) -> DataFrame:
    return df.where(~F.col(expected).eqNullSafe(F.col(actual)))


def row_differences(expected: DataFrame, actual: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of one side missing on the other, duplicates counted, as (side, columns, n_rows)."""
    left = expected.select(*columns, F.lit(1).alias("_n"))
    right = actual.select(*columns, F.lit(-1).alias("_n"))
    found = left.unionByName(right).groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n != 0")
    side = F.when(F.col("_n") > 0, F.lit("missing")).otherwise(F.lit("unexpected"))
    return found.select(side.alias("side"), *columns, F.abs("_n").alias("n_rows"))


@dataclass(frozen=True)
class Check:
    """Failing rows under a name. A check of single rows also says of which ``table`` they are and
    by which ``condition``, so that all checks of one table can be counted together."""

    name: str
    failing: DataFrame
    table: DataFrame | None = None
    condition: Column | None = None


def _row_check(name: str, df: DataFrame, condition: Column) -> Check:
    return Check(name, df.where(condition), df, condition)


def table_checks(
    name: str,
    df: DataFrame,
    unique: Sequence[str] = (),
    not_null: Sequence[str] = (),
    not_null_where: dict[str, str] | None = None,
    foreign: Sequence[tuple[str, DataFrame, str]] = (),
    accepted: dict[str, Sequence] | None = None,
) -> list[Check]:
    """The checks declared for one table."""
    out = [Check(f"{name}.{c}.unique", duplicate_keys(df, [c])) for c in unique]
    out += [_row_check(f"{name}.{c}.not_null", df, F.col(c).isNull()) for c in not_null]
    for c, w in (not_null_where or {}).items():
        out.append(_row_check(f"{name}.{c}.not_null_where", df, F.col(c).isNull() & F.expr(w)))
    for c, values in (accepted or {}).items():
        out.append(_row_check(f"{name}.{c}.accepted_values", df, F.col(c).isNotNull() & ~F.col(c).isin(*values)))
    out += [Check(f"{name}.{c}.relationship", orphan_keys(df, c, p, pc)) for c, p, pc in foreign]
    return out


def run_checks(checks: Sequence[Check]) -> DataFrame:
    """One row per check: failing row count and status.

    All checks on single rows of one table are one aggregate over one scan of it; a key that must
    be unique or known elsewhere takes a scan of its own.
    """
    together: dict[int, list[Check]] = {}
    parts = []
    for c in checks:
        if c.condition is None:
            parts.append(c.failing.agg(F.count("*").alias("failures")).select(F.lit(c.name).alias("check_name"), "failures"))
        else:
            together.setdefault(id(c.table), []).append(c)
    for some in together.values():
        counts = [F.struct(F.lit(c.name).alias("check_name"), F.count_if(c.condition).alias("failures")) for c in some]
        parts.append(some[0].table.agg(F.array(*counts).alias("found")).selectExpr("inline(found)"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    status = F.when(F.col("failures") == 0, F.lit("pass")).otherwise(F.lit("fail"))
    return rows.withColumn("status", status)


def summarise_checks(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count_if(F.col("status") == "pass").alias("passed"),
        F.count_if(F.col("status") == "fail").alias("failed"),
        F.count("*").alias("total"),
    )
