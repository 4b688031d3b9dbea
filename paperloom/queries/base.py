"""Registry of queries and the tables they derive from the supplied ones.

Each derived table exists twice: as a DataFrame function and as a SQL common table
expression, so that a query and its SQL start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import fixed
from paperloom.operators.chunking import chunk_documents
from paperloom.operators.marts import document_dimension
from paperloom.operators.relational import spread
from paperloom.session import cut_lineage, prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where there is one."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + select.strip()


WS_SQL = "(" + " || ".join(f"chr({ord(c)})" for c in fixed.WHITESPACE) + ")"


def strip_sql(expr: str) -> str:
    return f"trim({expr}, {WS_SQL})"


# --- staged texts ------------------------------------------------------------------------


def markdown(text: str = "text") -> Column:
    """The supplied prose as markdown: some lines become headings, table rows or bullets."""
    lines = F.transform(
        F.split(F.replace(F.col(text), F.lit("."), F.lit("。")), "\n"),
        lambda line, i: F.when(i % 5 == 4, F.concat(F.lit("## "), line))
        .when((i % 7 == 3) | (i % 7 == 4), F.concat(F.lit("| "), line))
        .when(i % 11 == 6, F.concat(F.lit("●"), line))
        .otherwise(line),
    )
    return F.array_join(lines, "\n\n")


MARKDOWN_SQL = """array_to_string(list_transform(string_split(replace(text, '.', '。'), chr(10)),
  lambda line, i: CASE WHEN (i - 1) % 5 = 4 THEN '## ' || line
                       WHEN (i - 1) % 7 IN (3, 4) THEN '| ' || line
                       WHEN (i - 1) % 11 = 6 THEN '●' || line
                       ELSE line END), chr(10) || chr(10))"""


def _minutes(start: str, count: Column) -> Column:
    return F.lit(start).cast("timestamp") + F.make_interval(mins=count.cast("int"))


def raw_documents(spark: SparkSession, sf_dir: str, text: Column | None = None) -> DataFrame:
    """File rows with metadata, as an object scan would give them, and their text or another one."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    d = d if text is None else d.withColumn("text", text)
    doc = F.col("doc_id").cast("string")

    def entry(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.lit(name).alias("name"), value.alias("value")))

    dated = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 500).cast("int")), "yyyy-MM-dd")
    named = F.when(F.col("lang") != "de", F.concat("lang", F.lit("%20"), "source", F.lit("%20"), dated, F.lit(".pdf")))
    fed = F.when(
        F.col("lang").isin("fr", "es"),
        F.date_format(_minutes("2023-12-01", F.col("doc_id") * 7), "yyyy-MM-dd'T'HH:mm:ss"),
    )
    return d.select(
        F.concat(F.lit("gs://store/web/"), "source", F.lit("/"), doc, F.lit(".pdf")).alias("uri"),
        F.col("doc_id").alias("generation"),
        F.lit("application/pdf").alias("content_type"),
        F.col("n_chars").alias("size"),
        F.md5("text").alias("md5_hash"),
        F.array_compact(
            F.array(
                entry("drive-file-id", F.when(F.col("source") == "src0", F.concat(F.lit("drive-"), doc))),
                entry("media-id", doc),
                entry("original-filename", named),
                entry("modified_gmt", fed),
            )
        ).alias("metadata"),
        _minutes("2024-01-01", F.col("doc_id")).alias("updated"),
        markdown().alias("markdown"),
    )


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted texts, without a model call."""
    from paperloom.functions.metadata import meta_value, modified_or, stored_document_id
    from paperloom.functions.text import percent_decode

    return raw_documents(spark, sf_dir).select(
        "uri",
        stored_document_id("metadata").alias("document_id"),
        percent_decode(meta_value("metadata", "original-filename")).alias("original_filename"),
        F.col("markdown").alias("extracted_markdown"),
        "content_type",
        "size",
        "md5_hash",
        modified_or("metadata", "updated").alias("updated_at"),
    )


STAGED = f"""
staged AS (
  SELECT 'gs://store/web/' || source || '/' || doc_id || '.pdf' AS uri,
         CASE WHEN source = 'src0' THEN 'drive-' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS document_id,
         CASE WHEN lang <> 'de' THEN lang || ' ' || source || ' '
              || strftime(DATE '2024-01-01' + CAST(doc_id % 500 AS INTEGER), '%Y-%m-%d') || '.pdf' END AS original_filename,
         {MARKDOWN_SQL} AS extracted_markdown,
         'application/pdf' AS content_type,
         n_chars AS size,
         md5(text) AS md5_hash,
         TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS updated,
         CASE WHEN lang IN ('fr', 'es') THEN TIMESTAMP '2023-12-01' + doc_id * 7 * INTERVAL 1 MINUTE END AS fed,
         coalesce(CASE WHEN lang IN ('fr', 'es') THEN TIMESTAMP '2023-12-01' + doc_id * 7 * INTERVAL 1 MINUTE END,
                  TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE) AS updated_at,
         doc_id, lang, source
  FROM documents)"""

STAMP = "%Y-%m-%dT%H:%M:%SZ"

# --- chunks ------------------------------------------------------------------------------


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(staged(spark, sf_dir), unique_ids=True)


_CARRY = "document_id, uri, content_type, size, md5_hash, updated_at"

# A text stays one row; each step adds a list that the next one reads.
_MARKED = """regexp_replace(chr(10) || replace(extracted_markdown, chr(13) || chr(10), chr(10)),
    '\\n(#{1,3} |[●▶]|\\*[^\\n*]{1,20}\\*)', chr(10) || chr(1) || chr(10) || '\\1', 'g')"""

SECTIONS = f"""
headed AS (
  SELECT *, string_split({_MARKED}, chr(1)) AS parts FROM staged),
titled_parts AS (
  SELECT *, list_filter(list_transform(parts, lambda s, i: {{'section': i - 1, 'text': {strip_sql('s')}}}),
    lambda s: s.text <> '') AS sections FROM headed)"""

PARAGRAPHS = f"""
laid AS (
  SELECT *, flatten(list_transform(sections, lambda s: list_filter(
    list_transform(string_split(s.text, chr(10) || chr(10)), lambda p, i:
      {{'section': s.section, 'at': i - 1, 'is_table': starts_with({strip_sql('p')}, '|'), 'text': {strip_sql('p')}}}),
    lambda p: p.text <> ''))) AS paragraphs FROM titled_parts)"""

BLOCKS = """
folded AS (
  SELECT *, CASE WHEN len(paragraphs) = 0 THEN paragraphs ELSE
    list_reduce(list_transform(paragraphs, lambda p: [p]), lambda done, p:
      CASE WHEN done[-1].section = p[1].section AND done[-1].is_table = p[1].is_table
           THEN list_append(done[1:-2], {'section': p[1].section, 'at': done[-1].at, 'is_table': p[1].is_table,
             'text': done[-1].text || CASE WHEN p[1].is_table THEN chr(10) ELSE chr(10) || chr(10) END || p[1].text})
           ELSE list_concat(done, p) END) END AS blocks FROM laid)"""

_SENTENCES = f"list_filter(list_transform(string_split(b.text, '。'), lambda s: {strip_sql('s')}), lambda s: s <> '')"

GROUPS = f"""
spread AS (
  SELECT *, list_transform(blocks, lambda b:
    CASE WHEN b.is_table OR length(b.text) <= 1500 THEN [b.text] ELSE {_SENTENCES} END) AS sentences FROM folded),
measured AS (
  SELECT *, list_transform(sentences, lambda ss: list_transform(ss, lambda s, k:
    CAST(list_sum(list_transform(ss[1:k], lambda x: length(x) + 1)) AS BIGINT) // 1500)) AS ranks FROM spread),
cut AS (
  SELECT *, flatten(list_transform(blocks, lambda b, i: list_transform(list_sort(list_distinct(ranks[i])), lambda g:
    {{'section': b.section, 'block': b.at, 'grp': g,
      'text': array_to_string(list_filter(sentences[i], lambda s, k: ranks[i][k] = g), '。')}}))) AS groups FROM measured)"""

NUMBERED = f"""
long_enough AS (
  SELECT *, list_filter(groups, lambda g: length({strip_sql('g.text')}) >= 10) AS pieces FROM cut),
numbered AS (
  SELECT {_CARRY}, unnest(range(len(pieces))) AS chunk_index, unnest(pieces) AS piece FROM long_enough),
chunks AS (
  SELECT {_CARRY}, chunk_index, piece.text AS chunk_text, md5(document_id || chunk_index) AS chunk_id FROM numbered)"""

# Texts that share an id are numbered together.
NUMBERED_TOGETHER = f"""
rows_of_all AS (
  SELECT {_CARRY}, unnest(groups) AS piece FROM cut),
chunks AS (
  SELECT {_CARRY}, piece.text AS chunk_text, chunk_index, md5(document_id || chunk_index) AS chunk_id FROM (
    SELECT *, row_number() OVER (PARTITION BY document_id
      ORDER BY piece.section, piece.block, piece.grp, md5(uri), uri) - 1 AS chunk_index
    FROM rows_of_all WHERE length({strip_sql('piece.text')}) >= 10))"""

CHUNKS = ",\n".join(x.strip() for x in (STAGED, SECTIONS, PARAGRAPHS, BLOCKS, GROUPS, NUMBERED))

# --- documents -----------------------------------------------------------------------------


def with_type(df: DataFrame) -> DataFrame:
    """Types and dates the way a classifier would add them, from the title alone."""
    kinds = (("src1", "journal"), ("src2", "photo_album"), ("src3", "monthly_announcement"), ("src4", "monthly_lunch_info"))
    kind = F.lit("uncategorized")
    for word, name in reversed(kinds):
        kind = F.when(F.contains("title", F.lit(word)), F.lit(name)).otherwise(kind)
    day = F.try_to_date(F.nullif(F.regexp_extract("title", r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd")
    return df.withColumn("document_type", kind).withColumn("publish_date", day)


def documents_dim(spark: SparkSession, sf_dir: str, chunked: DataFrame | None = None) -> DataFrame:
    rows = chunks(spark, sf_dir) if chunked is None else chunked
    return with_type(document_dimension(rows, staged(spark, sf_dir)))


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chunks and documents for queries that read them more than once.

    Chunks are written to the shared folder first, as the build does, so they are computed
    once and later reads scan only the columns they need.
    """
    rows = cut_lineage(chunks(spark, sf_dir), "chunks")
    return rows, documents_dim(spark, sf_dir, rows)


DIM = """
rolled AS (
  SELECT document_id, uri, count(*) AS total_chunks, max(content_type) AS content_type, max(size) AS size,
         max(md5_hash) AS md5_hash, max(updated_at) AS updated_at FROM chunks GROUP BY document_id, uri),
titled AS (
  SELECT r.*, coalesce(s.original_filename, regexp_extract(r.uri, '/([^/]+)$', 1)) AS title
  FROM rolled r LEFT JOIN staged s ON r.uri = s.uri),
dim AS (
  SELECT *, CASE WHEN contains(title, 'src1') THEN 'journal' WHEN contains(title, 'src2') THEN 'photo_album'
                 WHEN contains(title, 'src3') THEN 'monthly_announcement' WHEN contains(title, 'src4') THEN 'monthly_lunch_info'
                 ELSE 'uncategorized' END AS document_type,
         TRY_CAST(nullif(regexp_extract(title, '(\\d{4}-\\d{2}-\\d{2})', 1), '') AS DATE) AS publish_date
  FROM titled)"""
