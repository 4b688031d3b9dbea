"""Chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions.text import ws_trim
from paperloom.operators.chunking import (
    block_array,
    chunk_array,
    chunk_documents,
    chunk_fixed,
    paragraph_array,
    section_array,
    split_by_headings,
)
from paperloom.queries import base
from paperloom.queries.base import query, with_ctes


@query(
    "chunk_documents",
    with_ctes(base.CHUNKS, select="SELECT document_id, uri, chunk_index, chunk_text, chunk_id, size, md5_hash FROM chunks"),
)
def _chunk_documents(spark, sf):
    return base.chunks(spark, sf).select(
        "document_id", "uri", "chunk_index", "chunk_text", "chunk_id", "size", "md5_hash"
    )


@query(
    "split_headings",
    with_ctes(base.STAGED, base.SECTIONS, select="SELECT document_id, len(parts) AS n_sections FROM headed"),
)
def _split_headings(spark, sf):
    rows = base.staged(spark, sf)
    return rows.select("document_id", F.size(split_by_headings("extracted_markdown")).cast("long").alias("n_sections"))


def _exploded(spark, sf, array, **names):
    """Elements of an array as rows; a name ending in ``index`` or ``order`` is a place."""
    rows = base.staged(spark, sf).select("document_id", F.explode(array).alias("x"))
    field = {new: F.col(f"x.{old}") for new, old in names.items()}
    return rows.select("document_id", *[(c.cast("long") if n.endswith(("index", "order", "id")) else c).alias(n) for n, c in field.items()])


@query(
    "sections",
    with_ctes(
        base.STAGED,
        base.SECTIONS,
        """places AS (SELECT document_id, unnest(sections) AS s FROM titled_parts)""",
        select="SELECT document_id, s.section AS section_index, s.text AS section_text FROM places",
    ),
)
def _sections(spark, sf):
    return _exploded(spark, sf, section_array("extracted_markdown"), section_index="section", section_text="text")


@query(
    "paragraphs",
    with_ctes(
        base.STAGED,
        base.SECTIONS,
        base.PARAGRAPHS,
        """places AS (SELECT document_id, unnest(paragraphs) AS p FROM laid)""",
        select="SELECT document_id, p.section AS section_index, p.at AS para_index, p.is_table, p.text AS paragraph FROM places",
    ),
)
def _paragraphs(spark, sf):
    return _exploded(
        spark, sf, paragraph_array("extracted_markdown"), section_index="section", para_index="at", is_table="table", paragraph="text"
    )


@query(
    "islands_merge",
    with_ctes(
        base.STAGED,
        base.SECTIONS,
        base.PARAGRAPHS,
        base.BLOCKS,
        """places AS (SELECT document_id, unnest(blocks) AS b FROM folded)""",
        select="SELECT document_id, b.section AS section_index, b.at AS block_order, b.is_table, b.text AS block_text FROM places",
    ),
)
def _islands_merge(spark, sf):
    return _exploded(
        spark, sf, block_array("extracted_markdown"), section_index="section", block_order="at", is_table="table", block_text="text"
    )


@query(
    "regroup_sentences",
    with_ctes(
        base.STAGED,
        base.SECTIONS,
        base.PARAGRAPHS,
        base.BLOCKS,
        base.GROUPS,
        """places AS (SELECT document_id, unnest(groups) AS g FROM cut)""",
        select="SELECT document_id, g.section AS section_index, g.block AS block_order, g.grp AS group_id, g.text AS chunk_text FROM places",
    ),
)
def _regroup(spark, sf):
    groups = chunk_array("extracted_markdown", min_chars=0)
    return _exploded(spark, sf, groups, section_index="section", block_order="block", group_id="group", chunk_text="text")


@query(
    "number_chunks",
    with_ctes(base.CHUNKS, select="SELECT document_id, chunk_index, chunk_text, chunk_id FROM chunks"),
)
def _number_chunks(spark, sf):
    """Numbering by place where ids are not promised to be unique."""
    rows = chunk_documents(base.staged(spark, sf))
    return rows.select("document_id", "chunk_index", "chunk_text", "chunk_id")


@query(
    "chunk_shared_ids",
    with_ctes(
        base.STAGED.replace("staged AS", "own AS"),
        """staged AS (SELECT * REPLACE (lang AS document_id) FROM own)""",
        base.SECTIONS,
        base.PARAGRAPHS,
        base.BLOCKS,
        base.GROUPS,
        base.NUMBERED_TOGETHER,
        select="SELECT document_id, uri, chunk_index, md5(chunk_text) AS text_md5, chunk_id FROM chunks",
    ),
)
def _chunk_shared_ids(spark, sf):
    """Many texts under few document ids: numbering across rows, without one task per id."""
    rows = base.staged(spark, sf).drop("document_id")
    langs = F.split(F.col("original_filename"), " ").getItem(0)
    rows = rows.withColumn("document_id", F.coalesce(langs, F.lit("de")))
    return chunk_documents(rows).select(
        "document_id", "uri", "chunk_index", F.md5("chunk_text").alias("text_md5"), "chunk_id"
    )


_WINDOWS_SQL = """
texts AS (SELECT document_id, extracted_markdown AS t, length(extracted_markdown) AS n FROM staged),
windows AS (
  SELECT document_id, t, n, unnest(range(greatest(CAST(ceil(n / 2000) AS BIGINT), 1))) AS chunk_index FROM texts),
ends AS (
  SELECT *, substr(t, chunk_index * 2000 + 1, 2000) AS body FROM windows),
cuts AS (
  SELECT document_id, t, chunk_index,
         CASE WHEN (chunk_index + 1) * 2000 >= n THEN n
              WHEN contains(body, '。') THEN chunk_index * 2000 + length(body) - strpos(reverse(body), '。') + 1
              ELSE (chunk_index + 1) * 2000 END AS stop
  FROM ends)"""


@query(
    "chunk_fixed",
    with_ctes(
        base.STAGED,
        _WINDOWS_SQL,
        """starts AS (
  SELECT *, lag(stop, 1, 0) OVER (PARTITION BY document_id ORDER BY chunk_index) AS start FROM cuts)""",
        select="SELECT document_id, chunk_index, substr(t, start + 1, stop - start) AS chunk_text FROM starts",
    ),
)
def _chunk_fixed(spark, sf):
    rows = base.staged(spark, sf).select("document_id", "extracted_markdown")
    return chunk_fixed(rows, "extracted_markdown").withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(
    "chunk_fixed_windows",
    with_ctes(
        base.STAGED,
        _WINDOWS_SQL,
        select="""SELECT document_id, chunk_index,
  substr(t, chunk_index * 2000 + 1, stop - chunk_index * 2000) AS chunk_text FROM cuts""",
    ),
)
def _chunk_fixed_windows(spark, sf):
    rows = base.staged(spark, sf).select("document_id", "extracted_markdown")
    fixed_rows = chunk_fixed(rows, "extracted_markdown", carry=False)
    return fixed_rows.withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(
    "trim_unicode",
    f"SELECT doc_id, length({base.strip_sql('text')}) AS n_trimmed FROM documents WHERE {base.strip_sql('text')} <> ''",
)
def _trim_unicode(spark, sf):
    rows = base.table(spark, sf, "documents").where(ws_trim("text") != "")
    return rows.select("doc_id", F.length(ws_trim("text")).cast("long").alias("n_trimmed"))
