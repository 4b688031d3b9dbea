"""All queries of this subpackage."""

from __future__ import annotations

from paperloom.llm import chat, classifier, counts, decontaminate, infill, lines, mix, negatives, quality, shard, simhash, suffix, tokens
from paperloom.llm.store import ORACLE, QUERIES, Query

__all__ = ["chat", "classifier", "counts", "decontaminate", "infill", "lines", "mix", "negatives", "quality", "shard", "simhash", "suffix", "tokens", "queries", "oracle_sql"]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
