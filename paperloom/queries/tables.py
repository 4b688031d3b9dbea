"""Keyed tables, join shapes, ingest windows, readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import dates
from paperloom.functions.metadata import meta_value
from paperloom.functions.text import random_id
from paperloom.operators import marts
from paperloom.operators.relational import in_set, not_in
from paperloom.queries import base
from paperloom.queries.base import STAMP, query, table, with_ctes
from paperloom.session import cut_lineage, scratch_path
from paperloom.sources import state, tables

_ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def _orders(spark, sf):
    return table(spark, sf, "orders").select(*_ORDER_COLUMNS)


def _changed_orders(spark, sf):
    """Half of the orders re-priced, and every order once more under a new key."""
    o = _orders(spark, sf)
    dear = o.where("o_totalprice > 250000").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    top = o.agg(F.max("o_orderkey")).scalar()
    fresh = o.where("o_orderstatus = 'F'").withColumn("o_orderkey", F.col("o_orderkey") + top + 1)
    return dear.unionByName(fresh)


_CHANGED_SQL = """
target AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders),
source AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice FROM target WHERE o_totalprice > 250000
  UNION ALL
  SELECT o_orderkey + (SELECT max(o_orderkey) FROM target) + 1, o_custkey, o_orderstatus, o_totalprice
  FROM target WHERE o_orderstatus = 'F')"""
_UPSERT_SQL = with_ctes(
    _CHANGED_SQL,
    select="""
SELECT * FROM source UNION ALL
SELECT * FROM target WHERE o_orderkey NOT IN (SELECT o_orderkey FROM source)""",
)


@query("upsert_orders", _UPSERT_SQL)
def _upsert(spark, sf):
    return state.upsert(_orders(spark, sf), _changed_orders(spark, sf), ["o_orderkey"])


@query("keyed_table_merge", _UPSERT_SQL)
def _keyed_table(spark, sf):
    """The same merge through stored versions; merged twice, as a replayed batch would."""
    store = state.KeyedTable(spark, scratch_path(spark, "orders"), ["o_orderkey"])
    store.overwrite(_orders(spark, sf))
    change = _changed_orders(spark, sf)
    store.merge(change)
    return store.merge(change)


@query(
    "dated_table_merge",
    with_ctes(
        _CHANGED_SQL,
        """months AS (SELECT o_orderkey, date_trunc('month', o_orderdate) AS month FROM orders),
merged AS (
  SELECT s.*, 'new' AS origin FROM source s
  UNION ALL SELECT t.*, 'old' FROM target t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM source))""",
        select="""
SELECT m.o_orderkey, m.o_custkey, m.o_orderstatus, m.o_totalprice,
       CASE WHEN m.origin = 'new' THEN '1999-01-01' ELSE strftime(d.month, '%Y-%m-%d') END AS order_month
FROM merged m LEFT JOIN months d USING (o_orderkey)
WHERE m.o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') OR m.origin = 'new'""",
    ),
)
def _dated_table(spark, sf):
    """A merge into monthly folders that moves rows between them and drops some customers."""
    orders = table(spark, sf, "orders")
    month = F.trunc("o_orderdate", "MM")
    store = state.DatedTable(spark, scratch_path(spark, "orders-dated"), ["o_orderkey"], "order_month", ["o_custkey"])
    store.overwrite(orders.select(*_ORDER_COLUMNS, month.alias("order_month")))
    builders = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    moved = _changed_orders(spark, sf).withColumn("order_month", F.lit("1999-01-01").cast("date"))
    merged = store.merge(moved, drop=builders.select(F.col("c_custkey").alias("o_custkey")))
    return merged.select(*_ORDER_COLUMNS, F.col("order_month").cast("string").alias("order_month"))


@query(
    "upsert_composite_key",
    """
WITH source AS (
  SELECT l_orderkey, l_linenumber, l_partkey, max(l_quantity) AS qty FROM lineitem WHERE l_returnflag = 'R'
  GROUP BY l_orderkey, l_linenumber, l_partkey),
target AS (
  SELECT l_orderkey, l_linenumber, l_partkey, min(l_quantity) AS qty FROM lineitem
  GROUP BY l_orderkey, l_linenumber, l_partkey)
SELECT * FROM source UNION ALL
SELECT t.* FROM target t WHERE NOT EXISTS (SELECT 1 FROM source s WHERE s.l_orderkey = t.l_orderkey
  AND s.l_linenumber = t.l_linenumber AND s.l_partkey = t.l_partkey)""",
)
def _upsert_composite(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    lines = table(spark, sf, "lineitem")
    target = lines.groupBy(*keys).agg(F.min("l_quantity").alias("qty"))
    source = lines.where("l_returnflag = 'R'").groupBy(*keys).agg(F.max("l_quantity").alias("qty"))
    return state.upsert(target, source, keys)


def _revised(spark, sf):
    """Stored texts after a re-scan in which French ones changed."""
    french = F.split("original_filename", " ").getItem(0) == "fr"
    rows = base.staged(spark, sf)
    return rows.withColumn("md5_hash", F.when(french, F.md5(F.concat("md5_hash", F.lit("!")))).otherwise(F.col("md5_hash")))


_REVISED_SQL = """
revised AS (SELECT * REPLACE (CASE WHEN lang = 'fr' THEN md5(md5_hash || '!') ELSE md5_hash END AS md5_hash) FROM staged)"""


@query(
    "delete_stale_chunks",
    with_ctes(
        base.CHUNKS,
        _REVISED_SQL,
        select="""
SELECT document_id, chunk_index, chunk_id FROM chunks WHERE document_id NOT IN (
  SELECT s.document_id FROM revised s WHERE s.uri IN (SELECT uri FROM chunks)
  AND NOT EXISTS (SELECT 1 FROM chunks t WHERE t.uri = s.uri AND t.md5_hash = s.md5_hash))""",
    ),
)
def _delete_stale(spark, sf):
    chunks, _ = base.stored(spark, sf)
    kept = state.delete_stale_chunks(chunks, _revised(spark, sf))
    return kept.select("document_id", "chunk_index", "chunk_id")


@query(
    "skip_unchanged",
    with_ctes(
        base.STAGED,
        _REVISED_SQL,
        select="""
SELECT r.uri, r.md5_hash FROM revised r
WHERE NOT EXISTS (SELECT 1 FROM staged t WHERE t.uri = r.uri AND t.md5_hash = r.md5_hash)""",
    ),
)
def _skip_unchanged(spark, sf):
    fresh = state.skip_unchanged(_revised(spark, sf), base.staged(spark, sf), ["uri", "md5_hash"])
    return fresh.select("uri", "md5_hash")


@query(
    "incremental_chunks",
    with_ctes(
        base.CHUNKS,
        _REVISED_SQL,
        select="""
SELECT c.document_id, c.chunk_index, c.chunk_text, r.md5_hash FROM chunks c JOIN revised r ON c.uri = r.uri""",
    ),
)
def _incremental_chunks(spark, sf):
    """Re-chunk after a re-scan: stale chunks go, changed texts come back, the rest stays."""
    from paperloom.plans.build import merge_chunks

    full = cut_lineage(merge_chunks(None, base.staged(spark, sf), unique_ids=True), "chunks")
    return merge_chunks(full, _revised(spark, sf), unique_ids=True).select(
        "document_id", "chunk_index", "chunk_text", "md5_hash"
    )


@query(
    "delete_orphans",
    """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def _delete_orphans(spark, sf):
    parents = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_orderkey", "l_orderkey")
    kept = state.delete_orphans(table(spark, sf, "lineitem"), parents, "l_orderkey")
    return kept.select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "not_in_customers",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
)
def _not_in(spark, sf):
    dear = table(spark, sf, "orders").where("o_totalprice > 400000")
    return not_in(table(spark, sf, "customer"), dear, "c_custkey", "o_custkey").select("c_custkey", "c_name")


_WITH_NULL_SQL = """
SELECT doc_id FROM documents WHERE doc_id NOT IN
  (SELECT CASE WHEN toxic = 1 THEN NULL ELSE doc_id END FROM labels)"""


@query("not_in_null_aware", _WITH_NULL_SQL)
def _not_in_null(spark, sf):
    """A NULL among the inner keys empties NOT IN."""
    inner = table(spark, sf, "labels").select(F.when(F.col("toxic") != 1, F.col("doc_id")).alias("doc_id"))
    return not_in(table(spark, sf, "documents"), inner, "doc_id").select("doc_id")


@query(
    "semi_join_in",
    """
SELECT c_custkey, c_mktsegment FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
)
def _in_set(spark, sf):
    open_orders = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return in_set(table(spark, sf, "customer"), open_orders, "c_custkey", "o_custkey").select("c_custkey", "c_mktsegment")


@query(
    "backfill_updated_at",
    with_ctes(
        base.STAGED,
        select=f"SELECT document_id, uri, strftime(updated_at, '{STAMP}') AS updated_at FROM staged",
    ),
)
def _backfill(spark, sf):
    """Rows staged with the wrong time get it from the metadata."""
    old = base.staged(spark, sf).withColumn("updated_at", F.lit("2000-01-01").cast("timestamp"))
    fixed_rows = state.backfill_updated_at(old, base.raw_documents(spark, sf))
    return fixed_rows.select("document_id", "uri", dates.utc_stamp("updated_at").alias("updated_at"))


@query(
    "backfill_dimension",
    with_ctes(
        base.CHUNKS,
        base.DIM,
        select=f"SELECT document_id, title, strftime(updated_at, '{STAMP}') AS updated_at FROM dim",
    ),
)
def _backfill_dimension(spark, sf):
    old = base.documents_dim(spark, sf).withColumn("updated_at", F.lit("2000-01-01").cast("timestamp"))
    moved = state.propagate_updated_at(old, base.staged(spark, sf))
    return moved.select("document_id", "title", dates.utc_stamp("updated_at").alias("updated_at"))


@query(
    "time_window",
    with_ctes(
        base.STAGED,
        select=f"""
SELECT uri, strftime(updated_at, '{STAMP}') AS updated_at FROM staged
WHERE updated >= TIMESTAMP '2024-01-01 02:00:00' AND updated < TIMESTAMP '2024-01-01 14:00:00' + INTERVAL 1 DAY
  AND updated_at >= TIMESTAMP '2024-01-01 02:00:00' AND updated_at < TIMESTAMP '2024-01-01 14:00:00'""",
    ),
)
def _time_window(spark, sf):
    from paperloom.functions.metadata import modified_or

    rows = state.time_window(base.raw_documents(spark, sf), "2024-01-01 02:00:00", "2024-01-01 14:00:00")
    return rows.select("uri", dates.utc_stamp(modified_or("metadata", "updated")).alias("updated_at"))


@query(
    "assign_window",
    f"""
SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '{STAMP}') AS window_start,
       strftime(time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR, '{STAMP}') AS window_end, count(*) AS n_rows
FROM events GROUP BY ALL""",
)
def _assign_window(spark, sf):
    counted = state.rows_per_window(table(spark, sf, "events"), "ts")
    return counted.select(
        dates.utc_stamp("window_start").alias("window_start"), dates.utc_stamp("window_end").alias("window_end"), "n_rows"
    )


@query(
    "new_objects",
    "SELECT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE url LIKE 'https://%') GROUP BY url",
)
def _new_objects(spark, sf):
    pages = table(spark, sf, "pages").select("url")
    stored = pages.where(F.col("url").startswith("https://"))
    return state.new_objects(pages, stored, "url").distinct()


# --- readers and writers -------------------------------------------------------------------


@query("ndjson_roundtrip", "SELECT conv_id, turn, role, text FROM conversations")
def _ndjson(spark, sf):
    """Export a shard set of JSON lines and read all shards back."""
    rows = table(spark, sf, "conversations")
    path = scratch_path(spark, "ndjson")
    tables.export_ndjson(rows, path, ["conv_id", "turn", "role", "text"])
    return tables.read_ndjson(spark, path, rows.schema)


SOURCE_RULES = """
source_rules AS (
  SELECT source AS document_type, 'label ' || source AS label_ja, count(*) || ' texts, ' || sum(n_chars) || ' characters' AS description,
         CAST(substr(source, 4) AS BIGINT) AS sort_order
  FROM documents GROUP BY source)"""


def source_rules(spark, sf):
    """A rule per source of texts, describing how much it holds."""
    counted = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    return counted.select(
        F.col("source").alias("document_type"),
        F.concat(F.lit("label "), "source").alias("label_ja"),
        F.concat(F.col("n").cast("string"), F.lit(" texts, "), F.col("c").cast("string"), F.lit(" characters")).alias("description"),
        F.substring("source", 4, 10).cast("long").alias("sort_order"),
    )


@query(
    "rules_csv",
    with_ctes(SOURCE_RULES, select="SELECT document_type, label_ja, description, sort_order FROM source_rules"),
)
def _rules_csv(spark, sf):
    """A rule table written as CSV with a header and read with its fixed schema."""
    path = scratch_path(spark, "rules")
    source_rules(spark, sf).write.option("header", True).csv(path)
    return tables.read_rules(spark, path)


@query(
    "write_partitioned",
    """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS order_day, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY ALL""",
)
def _write_partitioned(spark, sf):
    """Orders written by month and clustered by customer, then rolled up per day."""
    path = scratch_path(spark, "orders-by-month")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    tables.write_partitioned(rows, path, "order_month", ["o_custkey"], F.trunc("o_orderdate", "MM"))
    return (
        spark.read.parquet(path)
        .groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day"))
        .agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )


@query("rebuild_table", "SELECT doc_id, quality, toxic FROM labels")
def _rebuild(spark, sf):
    path = scratch_path(spark, "rebuild")
    rows = table(spark, sf, "labels")
    tables.rebuild(rows.withColumn("quality", F.lit(0)), path)
    tables.rebuild(rows, path)
    return spark.read.parquet(path)


@query("scan_objects")
def _scan_objects(spark, sf):
    """Metadata and hashes of the stored files themselves."""
    return tables.scan_objects(spark, sf, "*.parquet", "application/vnd.apache.parquet").select(
        tables.file_name("uri").alias("name"), "content_type", "size", "md5_hash"
    )


@query(
    "object_listing",
    """
SELECT doc_id % 64 AS shard, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS size, 'text/plain' AS content_type,
       md5(CAST(doc_id % 64 AS VARCHAR)) AS md5_hash, CAST(count(*) AS VARCHAR) AS n_texts
FROM documents GROUP BY 1""",
)
def _object_listing(spark, sf):
    """Text files written from all documents, listed with the hashes and metadata of a sidecar; none is opened."""
    rows = table(spark, sf, "documents").select((F.col("doc_id") % 64).alias("shard"), F.coalesce("text", F.lit("")).alias("value"))
    path = scratch_path(spark, "objects")
    rows.repartition(64, "shard").write.partitionBy("shard").text(path)
    shard = F.regexp_extract("uri", r"shard=(\d+)", 1)
    listed = tables.scan_objects(spark, path, "*.txt", "text/plain", hash_content=False).select("uri", shard.alias("shard"))
    counts = rows.groupBy(F.col("shard").cast("string").alias("shard")).agg(F.count("*").cast("string").alias("n"))
    entry = F.array(F.struct(F.lit("n-texts").alias("name"), F.col("n").alias("value")))
    sidecar = listed.join(counts, "shard").select("uri", F.md5("shard").alias("md5_hash"), entry.alias("metadata"))
    found = tables.scan_objects(spark, path, "*.txt", "text/plain", sidecar)
    return found.select(shard.cast("long").alias("shard"), "size", "content_type", "md5_hash", meta_value("metadata", "n-texts").alias("n_texts"))


@query(
    "read_document_text",
    with_ctes(
        base.STAGED,
        select="""
SELECT document_id, extracted_markdown FROM staged WHERE document_id = (SELECT max(document_id) FROM staged)""",
    ),
)
def _read_document_text(spark, sf):
    rows = base.staged(spark, sf)
    newest = rows.agg(F.max("document_id")).scalar()
    return rows.where(F.col("document_id") == newest).select("document_id", "extracted_markdown")


@query(
    "list_recent",
    with_ctes(
        base.STAGED,
        select=f"""
SELECT uri, CAST(doc_id AS VARCHAR) AS generation, content_type, size, strftime(updated, '{STAMP}') AS updated
FROM staged ORDER BY staged.updated DESC, uri LIMIT 100""",
    ),
)
def _list_recent(spark, sf):
    return marts.list_recent(base.raw_documents(spark, sf))


@query(
    "literal_rows",
    """
WITH expected AS (
  SELECT 'en' AS lang, 'English' AS name UNION ALL SELECT 'fr', 'French' UNION ALL SELECT 'de', 'German'
  UNION ALL SELECT 'es', 'Spanish' UNION ALL SELECT 'xx', NULL)
SELECT e.lang, e.name, (SELECT count(*) FROM documents d WHERE d.lang = e.lang) AS n_documents FROM expected e""",
)
def _literal_rows(spark, sf):
    """Rows given in the query itself, one after the other, against the table."""
    rows = [("en", "English"), ("fr", "French"), ("de", "German"), ("es", "Spanish"), ("xx", None)]
    counts = table(spark, sf, "documents").groupBy(F.col("lang").alias("d_lang")).agg(F.count("*").alias("n"))
    expected = tables.literal_rows(spark, rows, "lang string, name string")
    found = expected.join(counts, F.col("lang") == F.col("d_lang"), "left")
    return found.select("lang", "name", F.coalesce("n", F.lit(0)).alias("n_documents"))


@query("surrogate_ids", "SELECT source, count(*) AS n_rows, count(*) AS n_ids, true AS well_formed FROM documents GROUP BY source")
def _surrogate_ids(spark, sf):
    """A random id per row: as many as rows, all of the usual form."""
    rows = table(spark, sf, "documents").select("source", random_id().alias("id"))
    form = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    grouped = rows.groupBy("source", "id").agg(F.count("*").alias("n"), F.bool_and(F.col("id").rlike(form)).alias("fine"))
    return grouped.groupBy("source").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_ids"), F.bool_and("fine").alias("well_formed"))
