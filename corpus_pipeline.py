"""The corpus pipeline: five operators in turn, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import decontaminate, mix, quality, simhash, tokens
from paperloom.llm.store import folder, recorded, remove, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that fail the base rules or their language's perplexity band go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return simhash.keep_one(docs)


def benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item go."""
    return decontaminate.without_matches(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them."""
    return mix.copies(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the token files."""
    import public_tokenizers

    files = folder(spark, "tokens")
    tokens.write_tokens(docs, files, public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.read_tokens(spark, files, digest=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_copies", benchmark_copies),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again.

    Once they are written, the tables behind them and the stage's own input copy go. Those of the
    last stage stay, as its rows are still to be read.
    """
    docs, old = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with recorded() as made:
            rows = stage(spark, docs, sf_dir)
        path = folder(spark, f"pipeline-{name}")
        rows.write.parquet(path)
        remove(spark, made + old)
        docs, old = spark.read.schema(rows.schema).parquet(path), [path]
    return STAGES[-1][1](spark, docs, sf_dir)
