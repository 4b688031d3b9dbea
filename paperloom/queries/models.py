"""Prompts, batch inference with the offline models, validation and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom import fixed
from paperloom.functions import dates
from paperloom.operators import compare, infer, marts
from paperloom.operators.chunking import chunk_documents
from paperloom.operators.infer import CLASSIFICATION, EVENT_ITEM, EVENTS, EXTRACTION
from paperloom.queries import base
from paperloom.queries.base import STAMP, query, strip_sql, table, with_ctes
from paperloom.queries.events import results as event_results
from paperloom.queries.tables import SOURCE_RULES, source_rules
from paperloom.session import cut_lineage

WORDS = {"src1": "journal", "src2": "photo_album", "src3": "monthly_announcement", "src4": "monthly_lunch_info"}

RULES = f"""
{SOURCE_RULES.strip()},
rules AS (
  SELECT string_agg('- ' || document_type || ': ' || description, chr(10) ORDER BY sort_order) AS rules_text FROM source_rules)"""


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("rules_text", with_ctes(RULES, select="SELECT rules_text FROM rules"))
def _rules_text(spark, sf):
    return infer.rules_text(source_rules(spark, sf))


@query(
    "classify_prompt",
    with_ctes(
        base.CHUNKS,
        base.DIM,
        RULES,
        select=f"""
SELECT document_id, title, {_lit(fixed.CLASSIFICATION_PROMPT_HEAD)} || title || {_lit(fixed.CLASSIFICATION_PROMPT_RULES)}
       || rules_text AS prompt FROM titled, rules""",
    ),
)
def _classify_prompt(spark, sf):
    dim = marts.document_dimension(base.chunks(spark, sf), base.staged(spark, sf))
    return infer.with_classification_prompt(dim, source_rules(spark, sf)).select("document_id", "title", "prompt")


@query(
    "event_prompt",
    with_ctes(
        base.CHUNKS,
        base.DIM,
        select=f"""
SELECT s.document_id, md5({_lit(fixed.EVENT_PROMPT_HEAD)} || strftime(coalesce(d.publish_date, CAST(s.updated_at AS DATE)), '%Y年%m月%d日')
       || {_lit(fixed.EVENT_PROMPT_RULES)} || s.extracted_markdown) AS prompt_md5, length(s.extracted_markdown) AS n_chars
FROM staged s LEFT JOIN dim d ON s.document_id = d.document_id""",
    ),
)
def _event_prompt(spark, sf):
    asked = infer.with_event_prompt(base.staged(spark, sf), base.documents_dim(spark, sf))
    return asked.select(
        "document_id", F.md5("prompt").alias("prompt_md5"), F.length("extracted_markdown").cast("long").alias("n_chars")
    )


@query(
    "stage_texts",
    with_ctes(
        base.STAGED,
        select=f"""
SELECT uri, document_id, original_filename, md5(extracted_markdown) AS text_md5, size, md5_hash,
       strftime(updated_at, '{STAMP}') AS updated_at FROM staged WHERE {strip_sql('extracted_markdown')} <> ''""",
    ),
)
def _stage(spark, sf):
    """Text extraction with a model that returns what it is given."""
    prompt = infer.extraction_prompt("markdown")
    generated = infer.infer_text(base.raw_documents(spark, sf), prompt, infer.EchoExtractor(), EXTRACTION)
    return marts.stage_texts(generated).select(
        "uri",
        "document_id",
        "original_filename",
        F.md5("extracted_markdown").alias("text_md5"),
        "size",
        "md5_hash",
        dates.utc_stamp("updated_at").alias("updated_at"),
    )


def _classified(spark, sf, words=WORDS):
    dim = marts.document_dimension(base.chunks(spark, sf), base.staged(spark, sf))
    asked = infer.with_classification_prompt(dim, source_rules(spark, sf))
    return infer.infer_text(asked, "prompt", infer.KeywordClassifier(words), CLASSIFICATION)


@query(
    "infer_classify",
    with_ctes(
        base.CHUNKS,
        base.DIM,
        select="""
SELECT document_id, title, document_type, strftime(coalesce(publish_date, CAST(updated_at AS DATE)), '%Y-%m-%d') AS publish_date,
       total_chunks FROM dim""",
    ),
)
def _infer_classify(spark, sf):
    typed = infer.parse_classification(_classified(spark, sf))
    return typed.select(
        "document_id", "title", "document_type", F.col("publish_date").cast("string").alias("publish_date"), "total_chunks"
    )


def _dated_lines(text: str):
    """Every sixth line of a text gets a date in front, some a clock time behind it."""
    return F.array_join(
        F.transform(
            F.split(text, "\n", -1),
            lambda line, i: F.when(
                i % 6 == 0,
                F.concat(
                    F.lit("2026-"), F.lpad((i % 12 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((i % 28 + 1).cast("string"), 2, "0"),
                    F.when(i % 12 == 0, F.lit(" 9:30 ")).otherwise(F.lit(" ")), line,
                ),
            ).otherwise(line),
        ),
        "\n",
    )


@query(
    "infer_events",
    with_ctes(
        base.STAGED,
        """lines AS (
  SELECT document_id, unnest(list_transform(string_split(extracted_markdown, chr(10)), lambda l, i: CASE WHEN (i - 1) % 6 = 0
    THEN '2026-' || lpad(CAST((i - 1) % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST((i - 1) % 28 + 1 AS VARCHAR), 2, '0')
      || CASE WHEN (i - 1) % 12 = 0 THEN ' 9:30 ' ELSE ' ' END || l ELSE l END)) AS line FROM staged)""",
        """dated AS (
  SELECT document_id, line, regexp_extract(line, '([0-9]{4})[-年]([0-9]{1,2})[-月]([0-9]{1,2})日?', ['y', 'm', 'd']) AS day,
         regexp_extract(line, '[0-9]{4}[-年][0-9]{1,2}[-月][0-9]{1,2}日?((.|\n)*)$', 1) AS rest
  FROM lines WHERE regexp_matches(line, '[0-9]{4}[-年][0-9]{1,2}[-月][0-9]{1,2}日?'))""",
        f"""events_found AS (
  SELECT document_id, day.y || '-' || day.m || '-' || day.d AS day_text, regexp_extract(rest, '[0-9]{{1,2}}:[0-9]{{2}}') AS clock,
         {strip_sql("regexp_replace(rest, '[0-9]{1,2}:[0-9]{2}', '')")} AS title FROM dated)""",
        select="""
SELECT DISTINCT document_id, CAST(TRY_CAST(day_text AS DATE) AS VARCHAR) AS event_date,
       md5(document_id || day_text || clock || title) AS event_id, title AS event_title
FROM events_found WHERE TRY_CAST(day_text AS DATE) IS NOT NULL AND title <> ''""",
    ),
)
def _infer_events(spark, sf):
    """All dated lines of the whole texts, through the event prompt and the offline model."""
    rows = base.staged(spark, sf).withColumn("extracted_markdown", _dated_lines("extracted_markdown"))
    asked = infer.with_event_prompt(rows, base.documents_dim(spark, sf))
    generated = infer.infer_text(asked, "prompt", infer.DatedLineExtractor(), EVENTS).where("status = ''")
    found = marts.extract_events(generated, F.lit("2024-02-01").cast("timestamp"))
    return found.select("document_id", F.col("event_date").cast("string").alias("event_date"), "event_id", "event_title")


@query(
    "infer_embed",
    with_ctes(
        base.CHUNKS,
        select="SELECT document_id, count(*) AS n_vectors, count(*) AS n_unit, 64 AS width FROM chunks GROUP BY document_id",
    ),
)
def _infer_embed(spark, sf):
    """A unit vector for every chunk."""
    rows = infer.infer_embedding(base.chunks(spark, sf), "chunk_text", infer.HashingEmbedder(64))
    norm = F.aggregate("chunk_embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return (
        rows.withColumn("norm", norm)
        .groupBy("document_id")
        .agg(
            F.count("chunk_embedding").alias("n_vectors"),
            F.count_if(F.abs(F.col("norm") - 1) < 1e-5).alias("n_unit"),
            F.max(F.size("chunk_embedding")).cast("long").alias("width"),
        )
    )


@query(
    "incremental_embed",
    with_ctes(
        base.CHUNKS,
        select="SELECT document_id, chunk_index, md5(document_id || ':' || chunk_index) AS chunk_id, true AS has_vector FROM chunks",
    ),
)
def _incremental_embed(spark, sf):
    """Vectors of a shorter earlier table plus the chunks it lacked, without its orphans."""
    all_chunks = cut_lineage(chunk_documents(base.staged(spark, sf), unique_ids=True, id_separator=":"), "chunks")
    earlier = all_chunks.where("size < 1500").unionByName(
        all_chunks.where("chunk_index = 0").withColumn("chunk_id", F.md5(F.concat("chunk_id", F.lit("gone"))))
    )
    model = infer.HashingEmbedder(32)
    target = infer.infer_embedding(earlier, "chunk_text", model)
    now = infer.incremental_embed(all_chunks, target, model)
    return now.select(
        "document_id", "chunk_index", "chunk_id", F.col("chunk_embedding").isNotNull().alias("has_vector")
    )


@query(
    "validate_results",
    """
SELECT doc_id, CASE WHEN lang = 'de' THEN 'missing document_type' WHEN lang = 'es' THEN 'unknown document_type'
                    WHEN lang = 'fr' THEN 'malformed' END AS problem FROM documents""",
)
def _validate(spark, sf):
    """Results with the faults a model can make, by language."""
    body = (
        F.when(F.col("lang") == "de", F.lit('{"publish_date": "2024-01-01"}'))
        .when(F.col("lang") == "es", F.lit('{"document_type": "poem"}'))
        .when(F.col("lang") == "fr", F.lit('{"document_type": "journal"'))
        .otherwise(F.lit('{"document_type": "journal", "publish_date": null}'))
    )
    rows = table(spark, sf, "documents").select("doc_id", body.alias("llm_result"))
    return infer.validate_result(rows, CLASSIFICATION).select("doc_id", "problem")


@query(
    "validate_events",
    """
SELECT event_type, 4 * count(*) AS n_items, 0 AS n_faulty FROM events GROUP BY event_type""",
)
def _validate_events(spark, sf):
    """Every item of every event result carries its required fields."""
    from paperloom.functions import json

    # As columns of a generator the checks are made once a row and stay behind the spreading of the rows.
    checks = F.struct(infer.result_problem("llm_result", EVENTS).alias("problem"), marts.event_items("llm_result").alias("items"))
    ids = json.expand(event_results(spark, sf).select("llm_result"), checks).where("problem is null")
    exploded = ids.select(F.get("items", 0)["event_title"].alias("event_type"), F.explode("items").alias("e"))
    faulty = infer.result_problem(F.to_json("e"), EVENT_ITEM).isNotNull()
    return exploded.groupBy("event_type").agg(F.count("*").alias("n_items"), F.count_if(faulty).alias("n_faulty"))


# --- comparison of two runs ------------------------------------------------------------------


def _label_results(spark, sf, column):
    kind = F.when(F.col(column) == 1, F.lit("journal")).otherwise(F.lit("uncategorized"))
    body = F.concat(F.lit('{"document_type": "'), kind, F.lit('", "publish_date": null}'))
    return table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"), body.alias("llm_result"))


TYPES = """
typed AS (
  SELECT doc_id AS document_id, CASE quality WHEN 1 THEN 'journal' ELSE 'uncategorized' END AS a_type,
         CASE toxic WHEN 1 THEN 'journal' ELSE 'uncategorized' END AS b_type FROM labels)"""


def _compared(spark, sf):
    sample = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "source")
    return compare.compare_classification(_label_results(spark, sf, "quality"), _label_results(spark, sf, "toxic"), sample)


@query(
    "compare_classification",
    with_ctes(
        TYPES,
        select="""
SELECT document_id, source, a_type, b_type, a_type = b_type AS type_match FROM typed
JOIN (SELECT doc_id AS document_id, source FROM documents) USING (document_id)""",
    ),
)
def _compare_classification(spark, sf):
    return _compared(spark, sf).select("document_id", "source", "a_type", "b_type", "type_match")


@query(
    "sample_rows",
    "SELECT doc_id, lang, source FROM documents ORDER BY md5(text), doc_id LIMIT 10",
)
def _sample(spark, sf):
    """The ten-document sample of a comparison, repeatable by its order."""
    rows = table(spark, sf, "documents").select("doc_id", "lang", "source", F.md5("text").alias("order_key"))
    return compare.sample_rows(rows, 10, "order_key", "doc_id").drop("order_key")


@query(
    "classification_agreement",
    with_ctes(
        TYPES,
        select="""
SELECT count(*) AS n_documents, count(*) FILTER (WHERE a_type = b_type) AS n_matching,
       round(count(*) FILTER (WHERE a_type = b_type) / count(*)::DOUBLE, 6) AS agreement,
       count(*) FILTER (WHERE a_type = b_type) / count(*)::DOUBLE >= 0.8 AS accepted FROM typed""",
    ),
)
def _agreement(spark, sf):
    return compare.classification_agreement(_compared(spark, sf)).withColumn("agreement", F.round("agreement", 6))


def _text_results(spark, sf, text):
    body = F.to_json(F.struct(text.alias("extracted_markdown")))
    failed = F.when(F.col("source") == "src9", F.lit("RETRY")).otherwise(F.lit(""))
    return base.spread(table(spark, sf, "documents"), "doc_id").select(
        F.col("doc_id").cast("string").alias("uri"), body.alias("llm_result"), failed.alias("status")
    )


@query(
    "compare_length",
    """
SELECT CAST(doc_id AS VARCHAR) AS uri, length(text) AS a_len, length(replace(text, 'e', '')) AS b_len,
       CAST(round((length(text) - length(replace(text, 'e', '')))::DOUBLE / nullif(length(text), 0), 3) AS DOUBLE) AS length_diff_ratio,
       (length(text) - length(replace(text, 'e', '')))::DOUBLE / nullif(length(text), 0) < 0.2 AS length_ok,
       left(text, 500) AS a_preview, left(replace(text, 'e', ''), 500) AS b_preview
FROM documents WHERE source <> 'src9'""",
)
def _compare_length(spark, sf):
    """The texts against themselves without the letter e."""
    a = _text_results(spark, sf, F.col("text"))
    b = _text_results(spark, sf, F.replace(F.col("text"), F.lit("e"), F.lit("")))
    return (
        compare.compare_text_length(a, b)
        .withColumn("a_len", F.col("a_len").cast("long"))
        .withColumn("b_len", F.col("b_len").cast("long"))
    )


@query(
    "compare_events",
    """
SELECT 'doc-' || event_id AS document_id, 4 AS a_event_count, CASE WHEN event_type = 'error' THEN 1 ELSE 3 END AS b_event_count,
       CASE WHEN event_type = 'error' THEN 3 ELSE 1 END AS count_diff, 3 AS a_valid_dates,
       CASE event_type WHEN 'click' THEN 3 WHEN 'error' THEN 1 ELSE 2 END AS b_valid_dates, event_type <> 'error' AS count_ok,
       event_type IN ('click', 'error') AS all_dates_valid
FROM events""",
)
def _compare_events(spark, sf):
    """Results against a run that lost the first event, of errors all but the last one, and that for
    clicks fixed the bad date."""
    a = event_results(spark, sf)
    lost = lambda c: F.regexp_replace(c, r'^\{"events": \[\{[^}]*\}, ', '{"events": [')
    shorter = lost("llm_result")
    shorter = F.when(F.contains("llm_result", F.lit('"event_title": "error"')), lost(lost(shorter))).otherwise(shorter)
    fixed_date = F.replace(shorter, F.lit("2024-02-30"), F.lit("2024-02-28"))
    b = a.withColumn(
        "llm_result", F.when(F.contains("llm_result", F.lit('"event_title": "click"')), fixed_date).otherwise(shorter)
    )
    return compare.compare_events(a, b).drop("a_raw", "b_raw")
