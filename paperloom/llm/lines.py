"""Removal of repeated multi-line chunks whose edges the content chooses.

Every line with a word is hashed, and the hash alone puts it into one of ``CUTS`` classes. Two
neighbouring lines of one class, with all that stands between them, are a chunk: each class cuts
the whole text in its own way, and lines without a word never cut. Edges depend on nothing but the
edge lines themselves, so a passage is cut alike wherever it stands, and by two classes any three
lines with words hold a whole chunk. A chunk whose hash occurs more than once in the corpus is
also taken with the next line with a word before it, and with the one after it, which are the
lines that a repeated passage may have beyond its chunks. All of these are compared byte by byte,
by grouping on their text; of equal ones the first stays (smallest id, nulls last, then the
text's hash and the place) and the lines of the others go. So each line that goes stands in the
same surroundings at an earlier place, and the first of them stays.

Rows alike in id and text are one document: what stays in one of them stays in all. A null text
is empty and comes back null; a text whose lines all go comes back empty. An empty table gives an
empty result. Other columns are carried by ``drop_repeated``. Only DataFrame functions are used;
no step groups the copies of a chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.shard import row_key
from paperloom.llm.store import query, table, written

CUTS = 2
WORD = r"[^\x20\x09-\x0D]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _joined(lines: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(lines, first + 1, n), "\n")


def _class(line: Column) -> Column:
    return F.pmod(F.shiftright(F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long"), 4), F.lit(CUTS)).cast("int")


def chunk_array(text: Column) -> Column:
    """array<struct<first, n, before, after, hash>>: a text's chunks by their first line's number and
    their lines, and how many lines it is to the next lines with a word around them (0: none)."""

    def cut(lines: Column) -> Column:
        worded = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(WORD))
        return _let(worded, lambda w: _let(F.transform(w, lambda i: _class(F.get(lines, i))), lambda k: every_class(lines, w, k)))

    def every_class(lines: Column, w: Column, classes: Column) -> Column:
        def own(c: int) -> Column:
            places = F.filter(F.sequence(F.lit(0), F.size(classes) - 1), lambda j: F.get(classes, j) == c)
            return _let(places, lambda p: F.transform(F.slice(p, F.lit(2), F.size(p)), lambda end, j: chunk(lines, w, F.get(p, j), end)))

        return F.flatten(F.array(*[own(c) for c in range(CUTS)]))

    def chunk(lines: Column, w: Column, a: Column, b: Column) -> Column:
        first, last = F.get(w, a), F.get(w, b)
        n = last - first + 1
        return F.struct(
            first.alias("first"),
            n.alias("n"),
            F.coalesce(first - F.get(w, a - 1), F.lit(0)).alias("before"),
            F.coalesce(F.get(w, b + 1) - last, F.lit(0)).alias("after"),
            F.xxhash64(_joined(lines, first, n)).alias("hash"),
        )

    return _let(_lines(text), cut)


def _extended(chunks: Column) -> Column:
    """Each chunk's lines, and those with the line before or after."""

    def spans(c: Column) -> Column:
        def span(first: Column, n: Column) -> Column:
            return F.struct(first.alias("first"), n.alias("n"))

        before = F.when(c["before"] > 0, span(c["first"] - c["before"], c["n"] + c["before"]))
        after = F.when(c["after"] > 0, span(c["first"], c["n"] + c["after"]))
        return F.array_compact(F.array(span(c["first"], c["n"]), before, after))

    return F.flatten(F.transform(chunks, spans))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(key, first, n): the runs of lines to remove from (key, doc_id, text)."""
    chunks = written(docs.select("key", F.explode(chunk_array(F.col("text"))).alias("c")).select("key", "c.*"), "line-hashes")
    twice = chunks.groupBy(F.col("hash").alias("t_hash")).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("t_hash")
    again = chunks.join(written(twice, "line-twice"), F.col("hash") == F.col("t_hash"), "left_semi")
    again = again.groupBy(F.col("key").alias("a_key")).agg(F.collect_set(F.struct("first", "n", "before", "after")).alias("chunks"))  # of one text
    found = docs.join(written(again, "line-places"), F.col("key") == F.col("a_key"))

    def with_lines(lines: Column) -> Column:
        return F.transform(
            _extended(F.col("chunks")),
            lambda s: F.struct(s["first"].alias("first"), s["n"].alias("n"), _joined(lines, s["first"], s["n"]).alias("lines")),
        )

    spans = found.select("key", "doc_id", F.explode(_let(_lines(F.col("text")), with_lines)).alias("s"))
    spans = written(spans.select("key", "doc_id", "s.*"), "line-chunks")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "first", "n")
    kept = spans.groupBy("lines").agg(F.min(place).alias("p")).select("p.key", "p.first", "p.n")
    return spans.select("key", "first", "n").join(kept, ["key", "first", "n"], "left_anti")


def drop_repeated(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(row, text, n_lines, n_removed): every row of ``docs``, its text without repeated chunks,
    its lines and how many of them went."""
    key = F.unhex(row_key(id_column))
    gone = repeated_spans(docs.select(key.alias("key"), F.col(id_column).alias("doc_id"), F.col("text").cast("string").alias("text")))
    gone = gone.groupBy(F.col("key").alias("g_key")).agg(F.collect_set(F.struct("first", "n")).alias("gone"))  # of one text
    text = F.col("row.text").cast("string")  # carried once
    found = docs.select(F.struct("*").alias("row"), key.alias("key")).join(gone, F.col("key") == F.col("g_key"), "left")

    def kept(lines: Column) -> Column:
        out = F.flatten(F.transform("gone", lambda s: F.sequence(s["first"], s["first"] + s["n"] - 1)))
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), out)
        return _let(stay, lambda i: F.struct(F.array_join(F.transform(i, lambda k: F.get(lines, k)), "\n").alias("text"), F.size(i).alias("n")))

    n_lines = F.size(_lines(text))
    whole = F.struct(text.alias("text"), n_lines.alias("n"))
    done = F.when(F.col("gone").isNull(), whole).otherwise(_let(_lines(text), kept))
    found = found.select("row", n_lines.alias("n_lines"), done.alias("done"))
    return found.select("row", "done.text", F.col("n_lines").cast("long"), (F.col("n_lines") - F.col("done.n")).cast("long").alias("n_removed"))


_ORACLE = f"""
WITH docs AS (
  SELECT DISTINCT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines,
    md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, ''))) AS key
  FROM documents),
line AS (
  SELECT doc_id, key, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM docs),
worded AS (
  SELECT doc_id, key, i, (CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) >> 4) % {CUTS} AS class,
    lag(i) OVER (PARTITION BY key ORDER BY i) AS before, lead(i) OVER (PARTITION BY key ORDER BY i) AS after
  FROM line WHERE regexp_matches(line, '{WORD}')),
cut AS (
  SELECT doc_id, key, lag(i) OVER w AS first, i AS last, lag(before) OVER w AS before, after
  FROM worded WINDOW w AS (PARTITION BY key, class ORDER BY i)),
span AS (
  SELECT doc_id, key, first, last FROM cut WHERE first IS NOT NULL
  UNION SELECT doc_id, key, before, last FROM cut WHERE before IS NOT NULL AND first IS NOT NULL
  UNION SELECT doc_id, key, first, after FROM cut WHERE first IS NOT NULL AND after IS NOT NULL),
ranked AS (
  SELECT s.key, s.first, s.last, row_number() OVER (
    PARTITION BY array_to_string(d.lines[s.first + 1 : s.last + 1], chr(10)) ORDER BY s.doc_id NULLS LAST, s.key, s.first) AS place
  FROM span s JOIN docs d ON d.key = s.key),
gone AS (
  SELECT DISTINCT key, unnest(range(first, last + 1)) AS i FROM ranked WHERE place > 1)
SELECT l.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(g.i) AS BIGINT) AS n_removed,
  coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text
FROM line l LEFT JOIN gone g ON g.key = l.key AND g.i = l.i GROUP BY l.doc_id
"""


@query("op7_line_chunks", _ORACLE)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the multi-line chunks that stand elsewhere before."""
    return drop_repeated(table(spark, sf_dir, "documents")).select("row.doc_id", "n_lines", "n_removed", "text")
