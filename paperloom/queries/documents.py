"""Document tables, listings and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import dates
from paperloom.functions.metadata import meta_value, stored_document_id
from paperloom.functions.sql import register
from paperloom.functions.text import (
    byte_size_label,
    form_encode,
    last_segment,
    original_filename,
    percent_encode,
    safe_file_name,
    uri_bucket,
    uri_key,
)
from paperloom.operators import marts
from paperloom.queries import base
from paperloom.queries.base import STAMP, query, strip_sql, table, with_ctes
from paperloom.queries.tables import SOURCE_RULES, source_rules
from paperloom.session import cut_lineage


@query(
    "document_dimension",
    with_ctes(
        base.CHUNKS,
        base.DIM,
        select=f"""
SELECT document_id, uri, title, total_chunks, size, md5_hash, strftime(updated_at, '{STAMP}') AS updated_at FROM titled""",
    ),
)
def _dimension(spark, sf):
    dim = marts.document_dimension(base.chunks(spark, sf), base.staged(spark, sf))
    return dim.select(
        "document_id", "uri", "title", "total_chunks", "size", "md5_hash", dates.utc_stamp("updated_at").alias("updated_at")
    )


@query(
    "denormalise_chunks",
    with_ctes(
        base.CHUNKS,
        base.DIM,
        select="""
SELECT c.chunk_id, c.document_id, c.chunk_index, c.chunk_text, d.title, d.document_type,
       strftime(d.publish_date, '%Y-%m-%d') AS publish_date
FROM chunks c JOIN dim d ON c.document_id = d.document_id""",
    ),
)
def _denormalise(spark, sf):
    rows = marts.denormalise_chunks(*base.stored(spark, sf))
    return rows.withColumn("publish_date", F.col("publish_date").cast("string"))


@query(
    "document_detail",
    with_ctes(
        base.CHUNKS,
        base.DIM,
        """nested AS (
  SELECT document_id, CAST(0 AS BIGINT) AS part, count(*) AS n_chunks,
         string_agg(chunk_id, ',' ORDER BY chunk_index) AS chunk_ids, md5(string_agg(chunk_text, '|' ORDER BY chunk_index)) AS texts
  FROM chunks GROUP BY document_id)""",
        select="SELECT d.document_id, d.title, n.part, n.n_chunks, n.chunk_ids, n.texts FROM dim d JOIN nested n USING (document_id)",
    ),
)
def _detail(spark, sf):
    chunks, documents = base.stored(spark, sf)
    rows = marts.document_detail(documents, chunks)
    return rows.select(
        "document_id",
        "title",
        "part",
        F.size("chunks").cast("long").alias("n_chunks"),
        F.array_join("chunks.chunk_id", ",").alias("chunk_ids"),
        F.md5(F.array_join("chunks.chunk_text", "|")).alias("texts"),
    )


@query(
    "list_page",
    with_ctes(
        base.CHUNKS,
        base.DIM,
        select="""
SELECT document_id, title, document_type, strftime(publish_date, '%Y-%m-%d') AS publish_date FROM dim
WHERE document_type = 'journal' AND publish_date BETWEEN DATE '2024-02-01' AND DATE '2025-03-31'
ORDER BY dim.publish_date DESC NULLS LAST, document_id LIMIT 20 OFFSET 20""",
    ),
)
def _list_page(spark, sf):
    page = marts.list_page(base.documents_dim(spark, sf), "journal", "2024-02-01", "2025-03-31", offset=20)
    return page.select("document_id", "title", "document_type", F.col("publish_date").cast("string").alias("publish_date"))


@query(
    "list_after",
    with_ctes(
        base.CHUNKS,
        base.DIM,
        select="""
SELECT document_id, title, document_type, strftime(publish_date, '%Y-%m-%d') AS publish_date FROM dim
ORDER BY dim.publish_date DESC NULLS LAST, document_id LIMIT 20 OFFSET 20""",
    ),
)
def _list_after(spark, sf):
    """The second page, found from the last row of the first."""
    documents = cut_lineage(base.documents_dim(spark, sf), "documents")
    last = marts.list_after(documents).collect()[-1]  # one page
    page = marts.list_after(documents, (last.publish_date, last.document_id))
    return page.select("document_id", "title", "document_type", F.col("publish_date").cast("string").alias("publish_date"))


@query(
    "sort_nulls_last",
    with_ctes(
        base.CHUNKS,
        base.DIM,
        select=f"""
SELECT document_id, strftime(publish_date, '%Y-%m-%d') AS publish_date, strftime(updated_at, '{STAMP}') AS updated_at
FROM dim ORDER BY dim.publish_date DESC NULLS LAST,
  CASE WHEN dim.publish_date IS NULL THEN dim.updated_at END DESC NULLS LAST, document_id""",
    ),
)
def _sort_documents(spark, sf):
    return marts.sort_documents(base.documents_dim(spark, sf)).select(
        "document_id", F.col("publish_date").cast("string").alias("publish_date"), dates.utc_stamp("updated_at").alias("updated_at")
    )


@query(
    "facet_types",
    with_ctes(base.CHUNKS, base.DIM, select="SELECT DISTINCT document_type FROM dim WHERE document_type <> ''"),
)
def _facet(spark, sf):
    return marts.facet(base.documents_dim(spark, sf), "document_type")


_LABELS_SQL = """CASE document_type WHEN 'journal' THEN '日誌' WHEN 'photo_album' THEN 'フォトアルバム'
  WHEN 'monthly_announcement' THEN '園だより' WHEN 'monthly_lunch_info' THEN '給食便り' ELSE 'その他' END"""


@query(
    "document_cards",
    with_ctes(
        base.CHUNKS,
        base.DIM,
        select=f"""
SELECT document_id, title, {_LABELS_SQL} AS type_label, total_chunks,
       CASE WHEN size < 1024 THEN size || ' B'
            ELSE CAST(CAST(floor(size / 1024.0 * 10 + 0.5) AS BIGINT) // 10 AS VARCHAR) || '.'
                 || CAST(CAST(floor(size / 1024.0 * 10 + 0.5) AS BIGINT) % 10 AS VARCHAR) || ' KB' END AS size_label,
       strftime(coalesce(publish_date, CAST(updated_at AS DATE)), '%Y年%-m月%-d日') AS date_label
FROM dim""",
    ),
)
def _cards(spark, sf):
    return marts.document_cards(base.documents_dim(spark, sf))


@query(
    "type_labels",
    with_ctes(
        SOURCE_RULES,
        select="""
SELECT d.doc_id, coalesce(r.label_ja, d.code) AS type_label
FROM (SELECT doc_id, CASE lang WHEN 'en' THEN source ELSE lang END AS code FROM documents) d
LEFT JOIN source_rules r ON d.code = r.document_type""",
    ),
)
def _type_labels(spark, sf):
    """English texts are typed by source and find a label, others by language and do not."""
    code = F.when(F.col("lang") == "en", F.col("source")).otherwise(F.col("lang"))
    rows = table(spark, sf, "documents").select("doc_id", code.alias("document_type"))
    return marts.with_type_label(rows, source_rules(spark, sf)).select("doc_id", "type_label")


@query(
    "export_documents",
    with_ctes(
        base.CHUNKS,
        base.DIM,
        select=f"""
SELECT document_id, uri, title, document_type, strftime(publish_date, '%Y-%m-%d') AS publish_date, content_type, size,
       total_chunks, strftime(updated_at, '{STAMP}') AS updated_at FROM dim""",
    ),
)
def _export_documents(spark, sf):
    rows = marts.export_documents(base.documents_dim(spark, sf))
    return rows.withColumn("updated_at", dates.utc_stamp("updated_at"))


@query(
    "export_chunks",
    with_ctes(
        base.CHUNKS,
        base.DIM,
        select="""
SELECT c.chunk_id, c.document_id, c.chunk_index, c.chunk_text, d.title, d.document_type,
       strftime(d.publish_date, '%Y-%m-%d') AS publish_date
FROM chunks c JOIN dim d ON c.document_id = d.document_id""",
    ),
)
def _export_chunks(spark, sf):
    return marts.export_chunks(marts.denormalise_chunks(*base.stored(spark, sf)))


# --- scalar expressions over whole columns ---------------------------------------------------

_FORBIDDEN_SQL = r"""regexp_replace(replace(replace(replace(replace(replace({0}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'),
  '&quot;', '"'), '&#039;', ''''), '[/\\":*?<>|]', '', 'g')"""


@query(
    "sanitise_names",
    f"SELECT page_id, {_FORBIDDEN_SQL.format('html')} AS clean FROM pages",
)
def _sanitise(spark, sf):
    return table(spark, sf, "pages").select("page_id", safe_file_name("html").alias("clean"))


@query(
    "url_codecs",
    """
SELECT page_id, regexp_extract(url, '/([^/]+)$', 1) AS last_part,
       replace(replace(replace(replace(replace(url_encode(url), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS component,
       replace(replace(replace(url_encode(url), '%20', '+'), '%2A', '*'), '~', '%7E') AS form
FROM pages""",
)
def _codecs(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id",
        F.coalesce(last_segment("url"), F.lit("")).alias("last_part"),
        percent_encode("url").alias("component"),
        form_encode("url").alias("form"),
    )


@query(
    "original_filenames",
    """
SELECT conv_id, turn, replace(replace(replace(replace(replace(url_encode(role || ' ' || list_extract(string_split(
         replace(replace(text, '%', ''), chr(10), ' '), '/'), -1)), '%21', '!'),
         '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS original_filename
FROM conversations""",
)
def _original(spark, sf):
    """The encoded last path segment, from raw text as the path."""
    rows = table(spark, sf, "conversations")
    text = F.replace(F.replace("text", F.lit("%"), F.lit("")), F.lit("\n"), F.lit(" "))
    last = F.element_at(F.split(text, "/", -1), -1)
    url = F.concat(F.lit("https://example.com/files/"), F.col("role"), F.lit(" "), last)
    return rows.select("conv_id", "turn", original_filename(url).alias("original_filename"))


@query(
    "sql_functions",
    with_ctes(
        base.STAGED,
        base.SECTIONS,
        select=f"""
SELECT p.document_id, len(p.parts) AS n_sections, length({strip_sql('s.extracted_markdown')}) AS n_trimmed,
       md5(p.document_id || '7') AS eighth_chunk, coalesce(s.original_filename, '') AS file_name
FROM headed p JOIN staged s ON p.uri = s.uri""",
    ),
)
def _sql_functions(spark, sf):
    """The named SQL functions over all texts."""
    register(spark)
    rows = base.raw_documents(spark, sf).withColumn("document_id", stored_document_id("metadata"))
    rows = rows.withColumn("coded", meta_value("metadata", "original-filename"))
    return rows.selectExpr(
        "document_id",
        "CAST(size(split_by_headings(markdown)) AS BIGINT) AS n_sections",
        "CAST(length(trim_unicode(markdown)) AS BIGINT) AS n_trimmed",
        "chunk_id(document_id, 7) AS eighth_chunk",
        "coalesce(percent_decode(coded), '') AS file_name",
    )


@query(
    "uri_parts",
    with_ctes(
        base.STAGED,
        select="""
SELECT document_id, regexp_extract(uri, '^gs://([^/]+)/(.+)$', 1) AS bucket, regexp_extract(uri, '^gs://([^/]+)/(.+)$', 2) AS object_key
FROM staged""",
    ),
)
def _uri_parts(spark, sf):
    return base.staged(spark, sf).select("document_id", uri_bucket("uri").alias("bucket"), uri_key("uri").alias("object_key"))


@query(
    "size_labels",
    """
SELECT page_id, CASE WHEN n < 1024 THEN n || ' B'
  WHEN n < 1048576 THEN printf('%.1f', CAST(floor(n / 1024.0 * 10 + 0.5) AS DOUBLE) / 10) || ' KB'
  ELSE printf('%.1f', CAST(floor(n / 1048576.0 * 10 + 0.5) AS DOUBLE) / 10) || ' MB' END AS size_label
FROM (SELECT page_id, strlen(html) * (page_id % 90 + 1) AS n FROM pages)""",
)
def _size_labels(spark, sf):
    n = F.octet_length("html") * (F.col("page_id") % 90 + 1)
    return table(spark, sf, "pages").select("page_id", byte_size_label(n).alias("size_label"))
