"""The incremental build as a user runs it: window after window, then an edit."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from paperloom.operators import infer
from paperloom.plans.build import Build, Models
from paperloom.queries import base
from paperloom.queries.base import query, table, with_ctes
from paperloom.queries.models import WORDS
from paperloom.queries.searching import QUERY_WORDS, TEXT_HITS, messages
from paperloom.queries.tables import source_rules
from paperloom.session import cut_lineage, scratch_path

_LAST = "2030-01-01"


def _text(edited: bool):
    """Texts whose id is divisible by 10 lose their first words and gain an ending in the edit."""
    new = F.concat(F.substring("text", 200, 1 << 30), F.lit(" edited ending of the text."))
    return F.when(F.col("doc_id") % 10 == 0, new).otherwise(F.col("text")) if edited else F.col("text")


def built(spark, sf_dir, dated: bool = True) -> Build:
    """The tables after a first window, a second one and an edit of files known by then."""
    models = Models(infer.EchoExtractor(), infer.KeywordClassifier(WORDS), infer.DatedLineExtractor(), infer.LetterEmbedder())
    build = Build(spark, scratch_path(spark, "build"), source_rules(spark, sf_dir), models, dated=dated)
    first = base.raw_documents(spark, sf_dir)
    middle = table(spark, sf_dir, "documents").agg(F.floor(F.avg("doc_id")).alias("id")).first().id
    split = str(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=middle))
    how = {"as_of": "2024-02-01", "source": "markdown", "extracted_at": F.lit("2024-02-01").cast("timestamp"), "unique_ids": True, "id_separator": ":"}
    build.run(first, start="2000-01-01", end=split, **how)
    build.run(first, start=split, end=_LAST, **how)
    build.run(base.raw_documents(spark, sf_dir, _text(True)), refresh_changed=True, **how)
    return build


EDITED = """
documents AS (
  SELECT doc_id, lang, source, n_chars, CASE WHEN doc_id % 10 = 0 THEN substr(text, 200) || ' edited ending of the text.' ELSE text END AS text
  FROM main.documents)"""


@query(
    "incremental_build",
    with_ctes(
        EDITED, base.CHUNKS, base.DIM,
        select="""
SELECT md5(c.document_id || ':' || chunk_index) AS chunk_id, c.document_id, chunk_index, md5(chunk_text) AS text_md5, title, document_type,
       CAST(coalesce(publish_date, CAST(d.updated_at AS DATE)) AS VARCHAR) AS publish_date
FROM chunks c JOIN dim d USING (document_id)""",
    ),
)
def _incremental_build(spark, sf):
    """The search table that the three runs leave, which is the one of a full run over the edited files."""
    rows = built(spark, sf).search_chunks.read()
    return rows.select(
        "chunk_id", "document_id", "chunk_index", F.md5("chunk_text").alias("text_md5"), "title", "document_type",
        F.col("publish_date").cast("string").alias("publish_date"),
    )


@query(
    "incremental_search",
    with_ctes(
        EDITED, base.CHUNKS, base.DIM, QUERY_WORDS.replace("FROM documents", "FROM main.documents"), TEXT_HITS,
        select="SELECT query_id, document_id, title, chunk_text, chunk_index FROM text_hits",
    ),
)
def _incremental_search(spark, sf):
    """Batch search over the postings that the same runs kept up to date."""
    return built(spark, sf, dated=False).keyword_search_many(cut_lineage(messages(spark, sf), "messages"))
