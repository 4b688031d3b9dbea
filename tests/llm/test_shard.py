"""Shards of near-equal bytes."""

import zlib

from pyspark.sql import functions as F

from paperloom.llm import shard


def test_sizes_slots_and_checksums(spark):
    texts = [None, ""] + ["é" * (k * 37 % 400) for k in range(700)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("slot", F.lit("x"))
    rows = shard.shard_rows(df).select("row.doc_id", "size", "shard", "slot").collect()
    sizes = {i: len((t or "").encode()) + 1 for i, t in enumerate(texts)}
    assert {r.doc_id: r["size"] for r in rows} == sizes
    total, largest = sum(sizes.values()), max(sizes.values())
    for k in range(shard.SHARDS):
        own = [r for r in rows if r.shard == k]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / shard.SHARDS) <= largest


def test_splitters_are_the_nearest_boundaries(spark):
    sizes = [k * 7919 % 50 + 1 for k in range(300)]
    df = spark.createDataFrame([(k, "x" * (n - 1)) for k, n in enumerate(sizes)], "doc_id long, text string")
    rows = sorted((r.key, r["size"], r.shard) for r in shard.shard_rows(df).select("key", "size", "shard").collect())
    ends = [0]
    for _, n, _ in rows:
        ends.append(ends[-1] + n)
    for k in range(1, shard.SHARDS):
        target = ends[-1] * k / shard.SHARDS
        cut = ends[sum(1 for r in rows if r[2] < k)]
        assert abs(cut - target) == min(abs(e - target) for e in ends)


def test_odd_rows(spark, odd_docs, no_docs):
    assert shard.shard_rows(no_docs).collect() == []
    rows = shard.shard_rows(odd_docs).select("row.*", "shard", "slot").collect()
    assert len(rows) == odd_docs.count()
    got = spark.createDataFrame([(None, None)] * 500 + [(1, "a")], "doc_id long, text string")
    places = [(r.shard, r.slot) for r in shard.shard_rows(got).collect()]
    assert len(set(places)) == 501


def test_query_columns(spark, tmp_path):
    spark.createDataFrame([(1, "é"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in shard.op4(spark, str(tmp_path)).collect()}
    assert rows[1].text_crc32 == zlib.crc32("é".encode()) and rows[2].text_crc32 == 0
    assert rows[2]["size"] == 1 and rows[1].law == "bytes" and rows[1].grown_shard is None
