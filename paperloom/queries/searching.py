"""Keyword, title and vector search, fusion and conversation context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom import fixed
from paperloom.operators import infer, marts, search, vectors
from paperloom.queries import base
from paperloom.queries.base import query, strip_sql, table, with_ctes
from paperloom.session import cut_lineage, scratch_path, stored_copy

KEYWORDS = ["tion", "ciez"]


_MODEL = infer.LetterEmbedder()


def _search_chunks(spark, sf):
    """The search table, stored as the build stores it."""
    with stored_copy(base.chunks(spark, sf), "chunks") as chunks:
        return cut_lineage(marts.denormalise_chunks(chunks, base.documents_dim(spark, sf, chunks)), "search-chunks")


def _with_vectors(chunks: DataFrame) -> DataFrame:
    """The search table with the vector of each chunk."""
    return cut_lineage(infer.infer_embedding(chunks, "chunk_text", _MODEL), "search-vectors")


@query(
    "keyword_search",
    with_ctes(
        base.CHUNKS,
        base.DIM,
        select="""
SELECT c.document_id, d.title, c.chunk_text, c.chunk_index FROM chunks c JOIN dim d USING (document_id)
WHERE c.chunk_text LIKE '%tion%' OR c.chunk_text LIKE '%ciez%' ORDER BY c.document_id, c.chunk_index LIMIT 10""",
    ),
)
def _keyword(spark, sf):
    return search.keyword_search(_search_chunks(spark, sf), KEYWORDS)


@query(
    "title_search",
    with_ctes(
        base.CHUNKS,
        base.DIM,
        select="""
SELECT c.document_id, d.title, c.chunk_text, c.chunk_index FROM chunks c JOIN dim d USING (document_id)
WHERE d.title LIKE '%src7%' OR d.title LIKE '%2025-0_-11%' ORDER BY c.document_id, c.chunk_index LIMIT 25""",
    ),
)
def _title(spark, sf):
    return search.title_search(*base.stored(spark, sf), ["src7", "2025-0_-11"], limit=25)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search message per text: two of its words and the name of its source."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("query_id"),
        F.concat(
            F.regexp_extract("text", "([a-z]{9})", 1), F.lit("　 "), F.regexp_extract("text", "[a-z]{7}.* ([a-z]{6,8}) ", 1),
            F.lit("\t"), F.col("source"), F.lit("%"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 500).cast("int")), "yyyy-MM"),
        ).alias("message"),
    )


QUERY_WORDS = """
queries AS (
  SELECT doc_id AS query_id,
         list_filter([regexp_extract(text, '([a-z]{9})', 1), regexp_extract(text, '[a-z]{7}.* ([a-z]{6,8}) ', 1),
                      source || '%' || strftime(DATE '2024-01-01' + CAST(doc_id % 500 AS INTEGER), '%Y-%m')],
                     lambda w: w <> '') AS keywords
  FROM documents),
words AS (SELECT DISTINCT query_id, unnest(keywords) AS word FROM queries),
kinds AS (SELECT DISTINCT word FROM words)"""

TEXT_HITS = """
text_words AS (
  SELECT w.word, c.document_id, c.chunk_index FROM chunks c JOIN kinds w ON c.chunk_text LIKE '%' || w.word || '%'),
text_hits AS (
  SELECT query_id, document_id, d.title, c.chunk_text, chunk_index
  FROM (SELECT DISTINCT query_id, document_id, chunk_index FROM words JOIN text_words USING (word))
    JOIN chunks c USING (document_id, chunk_index) JOIN dim d USING (document_id)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY document_id, chunk_index) <= 10)"""

_COUNTS = "list_transform(string_split('{letters}', ''), lambda l: CAST({count} AS DOUBLE))"
LETTER_VECTORS = f"""
chunk_vectors AS (
  SELECT chunk_id, document_id, chunk_index, chunk_text,
         {_COUNTS.format(letters=_MODEL.letters, count="length(chunk_text) - length(replace(chunk_text, l, ''))")} AS v FROM chunks),
query_vectors AS (
  SELECT doc_id AS query_id, {_COUNTS.format(letters=_MODEL.letters, count="contains(message, l)")} AS q FROM (
    SELECT doc_id, concat_ws(' ', regexp_extract(text, '([a-z]{{9}})', 1), regexp_extract(text, '[a-z]{{7}}.* ([a-z]{{6,8}}) ', 1),
                             source || '%') AS message FROM documents)),
nearest AS (
  SELECT query_id, chunk_id, document_id, chunk_index, chunk_text, list_cosine_distance(v, q) AS distance
  FROM chunk_vectors, query_vectors WHERE list_sum(v) > 0 AND list_sum(q) > 0
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_distance(v, q), 7), chunk_id, document_id) <= 5),
vector_hits AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 7), chunk_id, document_id) AS position, chunk_id, document_id,
         d.title, n.chunk_text, chunk_index, distance FROM nearest n JOIN dim d USING (document_id))"""

TITLE_HITS = """
title_words AS (
  SELECT w.word, d.document_id FROM dim d JOIN kinds w ON d.title LIKE '%' || w.word || '%'),
title_hits AS (
  SELECT query_id, document_id, d.title, c.chunk_text, chunk_index
  FROM (SELECT DISTINCT query_id, document_id FROM words JOIN title_words USING (word))
    JOIN chunks c USING (document_id) JOIN dim d USING (document_id)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY document_id, chunk_index) <= 10)"""


@query("extract_keywords", with_ctes(QUERY_WORDS, select="SELECT query_id, array_to_string(keywords, '|') AS keywords FROM queries"))
def _extract_keywords(spark, sf):
    found = search.extract_keywords(messages(spark, sf))
    return found.select("query_id", F.array_join("keywords", "|").alias("keywords"))


@query(
    "tokenise_texts",
    f"""
SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '[\\s\\x{{0b}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'),
       lambda t: t <> '')) AS n_tokens FROM conversations""",
)
def _tokenise(spark, sf):
    rows = search.extract_keywords(table(spark, sf, "conversations"), "text")
    return rows.select("conv_id", "turn", F.size("keywords").cast("long").alias("n_tokens"))


@query(
    "keyword_search_many",
    with_ctes(
        base.CHUNKS, base.DIM, QUERY_WORDS, TEXT_HITS,
        select="SELECT query_id, document_id, title, chunk_text, chunk_index FROM text_hits",
    ),
)
def _keyword_many(spark, sf):
    chunks = _search_chunks(spark, sf)
    index = cut_lineage(search.text_postings(chunks, ["document_id", "chunk_index"], "chunk_text"), "postings")
    return search.keyword_search_many(chunks, messages(spark, sf), postings=index)


@query(
    "semantic_search",
    with_ctes(
        base.CHUNKS, base.DIM, LETTER_VECTORS,
        select="SELECT query_id, position, chunk_id, document_id, title, chunk_text, chunk_index, round(distance, 6) AS distance FROM vector_hits",
    ),
)
def _semantic(spark, sf):
    """The chunks nearest in meaning to a text made of every document."""
    found = search.semantic_search(_with_vectors(_search_chunks(spark, sf)), messages(spark, sf), _MODEL)
    return found.withColumn("distance", F.round("distance", 6))


@query(
    "query_embedding",
    with_ctes(
        base.CHUNKS, LETTER_VECTORS,
        select="""
SELECT 'query' AS kind, CAST(query_id AS VARCHAR) AS id, array_to_string(list_transform(q, lambda x: CAST(x AS INTEGER)), ',') AS vector FROM query_vectors
UNION ALL
SELECT 'document', chunk_id, array_to_string(list_transform(v, lambda x: CAST(x AS INTEGER)), ',') FROM chunk_vectors""",
    ),
)
def _query_embedding(spark, sf):
    """The vectors themselves, of queries and of chunks, which a model tells apart by the task."""
    asked = infer.infer_embedding(messages(spark, sf), "message", _MODEL, fixed.QUERY_TASK, "v").select(F.lit("query").alias("kind"), F.col("query_id").cast("string").alias("id"), "v")
    held = infer.infer_embedding(base.chunks(spark, sf), "chunk_text", _MODEL, name="v").select(F.lit("document").alias("kind"), F.col("chunk_id").alias("id"), "v")
    numbers = F.transform("v", lambda x: x.cast("int").cast("string"))
    return asked.unionByName(held).select("kind", "id", F.array_join(numbers, ",").alias("vector"))


@query(
    "title_search_many",
    with_ctes(
        base.CHUNKS, base.DIM, QUERY_WORDS, TITLE_HITS,
        select="SELECT query_id, document_id, title, chunk_text, chunk_index FROM title_hits",
    ),
)
def _title_many(spark, sf):
    return search.title_search_many(*base.stored(spark, sf), messages(spark, sf))


def _placed(hits: DataFrame) -> DataFrame:
    w = W.partitionBy("query_id").orderBy("document_id", "chunk_index")
    return hits.withColumn("position", F.row_number().over(w))


def _fused(spark, sf):
    """Hits by meaning, by title and by words; tools that are not searches have none."""
    chunks, documents = base.stored(spark, sf)
    queries = cut_lineage(messages(spark, sf), "messages")
    by_title = _placed(search.title_search_many(chunks, documents, queries))
    stored = _with_vectors(marts.denormalise_chunks(chunks, documents))
    by_text = _placed(search.keyword_search_many(stored, queries))
    by_meaning = search.semantic_search(stored, queries, _MODEL)
    return search.fuse_sources([("vectorSearch", by_meaning), ("titleSearch", by_title), ("keywordSearch", by_text), ("weather", by_text)])


FUSED = """
fused AS (
  SELECT * FROM (
    SELECT 0 AS tool_position, position, query_id, document_id, title, chunk_text, chunk_index FROM vector_hits
    UNION ALL
    SELECT 1, row_number() OVER (PARTITION BY query_id ORDER BY document_id, chunk_index), * FROM title_hits
    UNION ALL
    SELECT 2, row_number() OVER (PARTITION BY query_id ORDER BY document_id, chunk_index), * FROM text_hits)
  QUALIFY row_number() OVER (PARTITION BY query_id, document_id, chunk_index ORDER BY tool_position, position) = 1)"""


@query(
    "fuse_sources",
    with_ctes(
        base.CHUNKS, base.DIM, QUERY_WORDS, LETTER_VECTORS, TEXT_HITS, TITLE_HITS, FUSED,
        select="SELECT query_id, tool_position, position, document_id, title, chunk_index FROM fused",
    ),
)
def _fuse(spark, sf):
    return _fused(spark, sf).select("query_id", "tool_position", "position", "document_id", "title", "chunk_index")


def _ranked(spark, sf):
    """Fused hits with one running position per query."""
    return _fused(spark, sf).withColumn("position", F.col("tool_position") * 1000 + F.col("position"))


@query(
    "distinct_documents",
    with_ctes(
        base.CHUNKS, base.DIM, QUERY_WORDS, LETTER_VECTORS, TEXT_HITS, TITLE_HITS, FUSED,
        select="""
SELECT query_id, document_id, min(tool_position * 1000 + position) AS first_position,
       arg_max(title, tool_position * 1000 + position) AS title, arg_max(chunk_index, tool_position * 1000 + position) AS chunk_index
FROM fused GROUP BY query_id, document_id""",
    ),
)
def _distinct_documents(spark, sf):
    return search.distinct_documents(_ranked(spark, sf)).drop("chunk_text")


@query(
    "summarise_hits",
    with_ctes(
        base.CHUNKS, base.DIM, QUERY_WORDS, LETTER_VECTORS, TEXT_HITS, TITLE_HITS, FUSED,
        """titles AS (
  SELECT query_id, title, min(tool_position * 1000 + position) AS place, count(*) AS n FROM fused GROUP BY query_id, title),
found AS (
  SELECT query_id, sum(n) AS n, string_agg('・' || title, chr(10) ORDER BY place, title) AS titles FROM titles GROUP BY query_id)""",
        select="""
SELECT q.query_id, CASE WHEN f.n IS NULL
    THEN '「' || array_to_string(keywords, '、') || '」に一致する文書は見つかりませんでした。別のキーワードで検索してみてください。'
    ELSE '「' || array_to_string(keywords, '、') || '」で' || CAST(f.n AS BIGINT) || '件のチャンクが見つかりました。' || chr(10) || chr(10)
         || '関連文書:' || chr(10) || f.titles END AS response
FROM queries q LEFT JOIN found f USING (query_id)""",
    ),
)
def _summarise(spark, sf):
    return search.summarise_hits(search.extract_keywords(messages(spark, sf)), _ranked(spark, sf))


_CONTEXT_SQL = """
WITH past AS (
  SELECT conv_id, turn, role, text FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {n}),
asked AS (SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id),
rows AS (
  SELECT p.conv_id, 0 AS fresh, p.turn, p.role, p.text FROM past p JOIN asked USING (conv_id)
  WHERE {strip} <> ''
  UNION ALL SELECT conv_id, 1, NULL, 'user', text FROM asked WHERE {strip} <> '')
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY fresh, turn) AS seq, role, text FROM rows"""


def _context(spark, sf, n):
    rows = table(spark, sf, "conversations")
    asked = rows.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    return search.recent_context(rows, asked, n).withColumn("seq", F.col("seq").cast("long"))


@query("recent_context", _CONTEXT_SQL.format(n=10, strip=strip_sql("asked.text")))
def _recent(spark, sf):
    """The last user message of each conversation, asked again with its history."""
    return _context(spark, sf, 10)


@query("recent_context_3", _CONTEXT_SQL.format(n=3, strip=strip_sql("asked.text")))
def _recent_3(spark, sf):
    return _context(spark, sf, 3)


# --- vectors -------------------------------------------------------------------------------


def _vectors(spark, sf):
    return base.spread(table(spark, sf, "embeddings"), "vec_id")


def _label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of every label: queries computed from all vectors."""
    e = table(spark, sf_dir, "embeddings")
    means = (
        e.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("at", "x"))
        .groupBy("label", "at")
        .agg(F.avg("x").alias("x"))
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"])
    return means.groupBy(F.col("label").alias("query_id")).agg(ordered.alias("query_embedding"))


LABEL_QUERIES = """
numbers AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS place FROM embeddings),
means AS (SELECT label, place, avg(x) AS x FROM numbers GROUP BY label, place),
queries AS (SELECT label AS query_id, list(x ORDER BY place) AS q FROM means GROUP BY label),
scored AS (
  SELECT query_id, vec_id, label, list_cosine_distance(embedding::DOUBLE[], q) AS distance FROM embeddings, queries)"""

_TOPK_SQL = with_ctes(
    LABEL_QUERIES,
    select="""
SELECT query_id, vec_id, round(distance, 6) AS distance FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 7), vec_id) <= 5""",
)

_NAMES = {"id_col": "vec_id", "vector": "embedding"}


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


@query("vector_topk", _TOPK_SQL)
def _vector_topk(spark, sf):
    return _rounded(vectors.vector_search(_vectors(spark, sf), _label_queries(spark, sf), **_NAMES))


@query("vector_topk_cells", _TOPK_SQL)
def _vector_topk_cells(spark, sf):
    """The same search as if the queries were too many to travel with the tasks."""
    return _rounded(
        vectors.vector_search(
            _vectors(spark, sf), _label_queries(spark, sf), block_numbers=200, **_NAMES
        )
    )


@query(
    "vector_topk_rows",
    with_ctes(
        LABEL_QUERIES,
        select="""
SELECT query_id, vec_id, label, round(distance, 6) AS distance FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 7), vec_id) <= 5""",
    ),
)
def _vector_topk_rows(spark, sf):
    """Search results with the columns of the rows found."""
    base_rows = _vectors(spark, sf)
    found = _rounded(vectors.vector_search(base_rows, _label_queries(spark, sf), **_NAMES))
    return vectors.attach_rows(found, base_rows, "vec_id", ["label"])


@query("vector_search_gate", _TOPK_SQL)
def _gate(spark, sf):
    """Through the index when the table has enough rows, exact (all lists) either way."""
    rows = _vectors(spark, sf)
    index = vectors.build_ivf(rows, "embedding", id_col="vec_id")
    return _rounded(vectors.search(rows, _label_queries(spark, sf), index, probes=32, **_NAMES))


@query("ivf_topk_all_lists", _TOPK_SQL)
def _ivf_all(spark, sf):
    """Probing every list is exact."""
    index = vectors.build_ivf(_vectors(spark, sf), "embedding", lists=8, min_rows=1, id_col="vec_id")
    return _rounded(vectors.ivf_search(index, _label_queries(spark, sf), probes=8, **_NAMES))


# --- a stored index that follows its table ---------------------------------------------------


def _twentieth(spark, sf):
    """Every vector whose id is divisible by 20, as a query."""
    rows = table(spark, sf, "embeddings").where("vec_id % 20 = 0")
    return rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))


def _changed(rows: DataFrame) -> DataFrame:
    """The vectors after ids divisible by 9 got the opposite direction and ids divisible by 11 left."""
    turned = F.transform("embedding", lambda x: -x)
    rows = rows.where("vec_id % 11 <> 0")
    return rows.withColumn("embedding", F.when(F.col("vec_id") % 9 == 0, turned).otherwise(F.col("embedding")))


def _index(spark, sf, lists: int = 16) -> tuple[vectors.StoredIndex, DataFrame]:
    """An index over half of the vectors that then took in the others, the edits and the deletes."""
    rows = _vectors(spark, sf)
    index = vectors.StoredIndex(spark, scratch_path(spark, "vector-index"), "vec_id", "embedding")
    index.build(rows.where("vec_id % 2 = 0"), lists, min_rows=1)
    now = _changed(rows)
    index.update(now.where("vec_id % 2 = 1 OR vec_id % 9 = 0"), rows.where("vec_id % 11 = 0"))
    return index, now


_CHANGED = """
rows AS (
  SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN list_transform(embedding::DOUBLE[], lambda x: -x) ELSE embedding::DOUBLE[] END AS v
  FROM embeddings WHERE vec_id % 11 <> 0),
asked AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0)"""


@query("ivf_topk")
def _ivf(spark, sf):
    """The hits of an index kept up to date, with the probes that its recall curve asks for."""
    index, _ = _index(spark, sf)
    asked = _twentieth(spark, sf)
    index.tune(asked, 0.95)
    return _rounded(index.search(asked))


@query(
    "ivf_recall",
    with_ctes(_CHANGED, select="SELECT count(*) AS n_queries, sum(least(5, (SELECT count(*) FROM rows))) AS n_exact, true AS enough FROM asked"),
)
def _ivf_recall(spark, sf):
    """The same hits against the exact ones of all rows: at least nine in ten are found."""
    index, now = _index(spark, sf)
    asked = _twentieth(spark, sf)
    index.tune(asked, 0.95)
    found = index.search(asked).select("query_id", "vec_id", F.lit(1).alias("found"))
    exact = vectors.vector_search(now, asked, **_NAMES).select("query_id", "vec_id")
    both = exact.join(found, ["query_id", "vec_id"], "left")
    return both.agg(
        F.count_distinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_exact"), (F.count("found") >= 0.9 * F.count(F.lit(1))).alias("enough")
    )


@query(
    "ivf_upkeep",
    with_ctes(
        _CHANGED,
        select="""
SELECT query_id, vec_id, round(list_cosine_distance(v, q), 6) AS distance FROM rows, asked
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_distance(v, q), 7), vec_id) <= 5""",
    ),
)
def _ivf_upkeep(spark, sf):
    """All lists of the index after inserts, edits and deletes hold just the rows of the table."""
    index, _ = _index(spark, sf)
    return _rounded(vectors.ivf_search(index.index(), _twentieth(spark, sf), probes=16, **_NAMES))
