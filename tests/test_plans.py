"""Shuffles, push-down and joins of the physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from paperloom.operators import marts, relational, search, vectors
from paperloom.operators.chunking import chunk_documents
from paperloom.sources import state
from paperloom.streaming import jobs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange (?:hash|range|single|round)", plan(df), re.I))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("plans"))
    rows = spark.range(200).select(
        F.col("id").cast("string").alias("document_id"), F.concat(F.lit("u"), "id").alias("uri"),
        F.lit("文章。").alias("extracted_markdown"), F.lit("h").alias("md5_hash"), F.lit(1).alias("size"),
        F.lit("c").alias("content_type"), F.current_timestamp().alias("updated_at"), F.lit("n").alias("original_filename"),
    )
    rows.write.parquet(f"{root}/staged")
    return spark.read.parquet(f"{root}/staged")


def test_chunking_is_narrow(stored):
    p = plan(chunk_documents(stored, unique_ids=True).select("chunk_id", "chunk_text"))
    assert "Exchange" not in p and "Python" not in p
    assert "ReadSchema: struct<document_id:string,extracted_markdown:string>" in p


def test_shared_numbering_shuffles_texts_once(stored, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(chunk_documents(stored))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = p.splitlines()
    join = next(k for k, line in enumerate(lines) if "SortMergeJoin" in line)
    column = lines[join + 1].index(":-")  # the side of the texts, up to that of the counts
    end = next(k for k, line in enumerate(lines) if k > join and line[column : column + 2] == "+-")
    assert sum("Exchange hashpartitioning" in line for line in lines[join:end]) == 1


def test_group_limit_before_shuffle(stored):
    p = plan(relational.top_per_group(stored, ["size"], [F.col("uri")], 3))
    assert p.count("WindowGroupLimit") == 2 and p.index("Final") < p.index("Exchange") < p.index("Partial")


def test_not_in_does_not_broadcast_by_force(stored, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(relational.not_in(stored, stored, "uri"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in p and "BroadcastNestedLoopJoin" not in p and "LeftAnti" in p


def test_time_window_reaches_the_scan(spark, tmp_path):
    rows = spark.range(10).select(
        F.col("id").cast("string").alias("uri"), F.current_timestamp().alias("updated"),
        F.array().cast("array<struct<name:string,value:string>>").alias("metadata"),
    )
    rows.write.parquet(str(tmp_path / "raw"))
    p = plan(state.time_window(spark.read.parquet(str(tmp_path / "raw")), "2026-01-01", "2026-01-02"))
    assert "GreaterThanOrEqual(updated" in p and "LessThan(updated" in p


def test_point_read_is_pushed(stored):
    from paperloom.sources.tables import read_document_text

    assert "EqualTo(document_id,7)" in plan(read_document_text(stored, "7"))


def test_dimension_counts_before_the_join(stored):
    chunks = chunk_documents(stored, unique_ids=True)
    p = plan(marts.document_dimension(chunks, stored))
    assert p.index("Join") < p.index("partial_count")  # the join is above the aggregate
    below = p[p.index("functions=[partial_count") - 200 :]
    assert "HashAggregate(keys=" in below and "Sort [" not in below  # chunks are not sorted to be counted


def test_search_is_a_top_k(stored):
    chunks = chunk_documents(stored, unique_ids=True).withColumn("title", F.lit("t"))
    p = plan(search.keyword_search(chunks, ["a"]))
    assert "TakeOrderedAndProject" in p and "Exchange hash" not in p


def test_vector_search_moves_only_winners(spark):
    base = spark.range(100).select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, query_embedding array<double>")
    p = plan(vectors.vector_search(base, queries, id_col="id", vector="v"))
    assert p.index("Exchange") < p.index("MapInArrow")  # the scan side below the only shuffle
    assert p.count("Exchange") == 1 and "Cartesian" not in p and "NestedLoop" not in p


def test_rates_combine_before_the_shuffle(spark):
    rows = spark.range(10).select(F.timestamp_seconds("id").alias("ts"))
    assert "partial_count" in plan(jobs.rates(rows, "ts"))


def test_checks_of_one_table_scan_it_once(spark, tmp_path):
    from paperloom.operators import quality

    spark.range(10).selectExpr("id", "id + 1 AS a", "id + 2 AS b").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    checks = quality.table_checks("t", rows, ["id"], ["id", "a", "b"], {"a": "b > 3"}, accepted={"b": [2, 3, 4]})
    found = quality.run_checks(checks)
    assert plan(found).count("Scan parquet") == 2  # one for the rows, one for the unique key
    failures = {r.check_name: (r.failures, r.status) for r in found.collect()}
    assert failures["t.b.accepted_values"] == (7, "fail") and failures["t.a.not_null_where"] == (0, "pass") and len(failures) == 6


def test_batch_search_cuts_before_it_shuffles_pairs(spark, table):
    from paperloom.operators import search

    chunks = table([("d", 0, "t", "some words")], "document_id string, chunk_index bigint, title string, chunk_text string")
    text = plan(search.keyword_search_many(chunks, table([(1, "some wo%s")], "query_id int, message string")))
    assert "CartesianProduct" not in text and "Python" not in text
    assert text.count("WindowGroupLimit") >= 6  # each cut has a part inside the tasks


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    """A file is cut by bytes into more partitions than it has row groups; all rows lie in one of them."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from paperloom.operators.relational import spread

    path, before = str(tmp_path / "rows.parquet"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    pq.write_table(pa.table({"k": range(40_000), "v": [str(i * 7919) for i in range(40_000)]}), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        rows = spark.read.parquet(path)
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = [len(p) for p in spread(rows, "k").rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(sizes) == 40_000 and max(sizes) < 20_000
    even = spark.range(0, 1000, 1, spark.sparkContext.defaultParallelism)
    assert spread(even, "id") is even


def test_results_are_checked_after_their_rows_are_spread(spark, tmp_path):
    from paperloom.queries import catalog

    rows = [(i, "click", i) for i in range(10)]
    events = spark.createDataFrame(rows, "event_id long, event_type string, user_id long")
    events.selectExpr("*", "timestamp'2024-01-02 03:04:05' AS ts").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    found = catalog.queries()["validate_events"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "parse" in plan and "parse" not in plan[plan.index("RepartitionByExpression") :].lower()
    assert [tuple(r) for r in found.collect()] == [("click", 40, 0)]
