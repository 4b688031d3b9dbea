import datetime as dt

import pytest
from pyspark.sql import functions as F

from paperloom.operators.relational import last_wins, not_in
from paperloom.session import scratch_path
from paperloom.sources import state, tables
from paperloom.sources.state import DatedTable, KeyedTable


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_replaces_and_inserts(table):
    target = table([(1, "a"), (2, "b")], "k int, v string")
    source = table([(2, "B"), (3, "C")], "k int, v string")
    once = state.upsert(target, source, ["k"])
    assert pairs(once) == [(1, "a"), (2, "B"), (3, "C")]
    assert pairs(state.upsert(once, source, ["k"])) == pairs(once)
    assert pairs(state.upsert(None, source, ["k"])) == [(2, "B"), (3, "C")]
    with pytest.raises(ValueError, match="not unique"):
        state.upsert(target, table([(2, "x"), (2, "y")], "k int, v string"), ["k"], check=True)


@pytest.mark.parametrize(
    "inner, expected", [([1], [2]), ([1, None], []), ([], [None, 1, 2]), ([5], [1, 2])]
)
def test_not_in(table, inner, expected):
    df = table([(1,), (2,), (None,)], "k int")
    other = table([(i,) for i in inner], "o int")
    got = [r.k for r in not_in(df, other, "k", "o").collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


@pytest.mark.parametrize(
    "parents, left", [([1], [None, 1]), ([1, None], [None, 1, 2]), ([], []), ([9], [None])]
)
def test_delete_orphans(table, parents, left):
    df = table([(1,), (2,), (None,)], "chunk_id int")
    kept = state.delete_orphans(df, table([(p,) for p in parents], "chunk_id int"))
    assert sorted([r.chunk_id for r in kept.collect()], key=str) == sorted(left, key=str)


def test_stale_chunks(table):
    target = table([("d1", "u1", "h1"), ("d1", "u1", "h1"), ("d2", "u2", "h2"), ("d3", "u3", "h3")],
                   "document_id string, uri string, md5_hash string")
    source = table([("d1", "u1", "NEW"), ("d2", "u2", "h2"), ("d4", "u4", "h4")],
                   "document_id string, uri string, md5_hash string")
    assert [r.document_id for r in state.delete_stale_chunks(target, source).orderBy("document_id").collect()] == ["d2", "d3"]
    fresh = state.skip_unchanged(source, target, ["uri", "md5_hash"])
    assert sorted(r.document_id for r in fresh.collect()) == ["d1", "d4"]


def test_time_window(table):
    meta = "uri string, metadata array<struct<name:string,value:string>>, updated timestamp"
    t = dt.datetime
    rows = [
        ("early", [], t(2026, 1, 1, 5, 59)),
        ("start", [], t(2026, 1, 1, 6)),
        ("end", [], t(2026, 1, 1, 12)),
        ("fed", [("modified_gmt", "2026-01-01T07:00:00")], t(2026, 1, 2, 11)),
        ("fed late", [("modified_gmt", "2026-01-01T07:00:00")], t(2026, 1, 2, 12)),
        ("fed out", [("modified_gmt", "2025-12-01T07:00:00")], t(2026, 1, 1, 7)),
    ]
    df = table(rows, meta)
    got = state.time_window(df, "2026-01-01 06:00:00", "2026-01-01 12:00:00").collect()
    assert sorted(r.uri for r in got) == ["fed", "start"]
    assert state.time_window(df, "2026-01-01 06:00:00", None).count() == 6


def test_run_window():
    now = dt.datetime(2026, 3, 1, 13, 45, 12)
    assert state.run_window(now) == (dt.datetime(2026, 3, 1, 7), dt.datetime(2026, 3, 1, 13))
    bounds = (dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1))
    assert state.run_window(now, start=bounds[0], end=bounds[1]) == bounds


def test_keyed_table(spark, table):
    store = KeyedTable(spark, scratch_path(spark, "t"), ["k"])
    assert store.read() is None
    store.merge(table([(1, "a")], "k int, v string"))
    store.merge(table([(1, "b"), (2, "c")], "k int, v string"))
    assert pairs(store.read()) == [(1, "b"), (2, "c")]
    with pytest.raises(ValueError):
        store.merge(table([(1, "x"), (1, "y")], "k int, v string"))
    assert pairs(store.read()) == [(1, "b"), (2, "c")]
    store.expire(keep=1)
    assert pairs(store.read()) == [(1, "b"), (2, "c")]


def test_ndjson(spark, table, tmp_path):
    rows = table([(1, "a\nb"), (2, None)], "k int, v string")
    path = str(tmp_path / "docs")
    tables.export_ndjson(rows.repartition(2), path, ["k", "v"])
    assert pairs(tables.read_ndjson(spark, path, "k int, v string").na.fill("-")) == [(1, "a\nb"), (2, "-")]
    (tmp_path / "docs" / "blank.json").write_text('\n{"k": 3, "v": "x"}\n\n')
    assert tables.read_ndjson(spark, path, "k int, v string").count() == 3
    (tmp_path / "docs" / "bad.json").write_text("{oops\n")
    with pytest.raises(Exception):
        tables.read_ndjson(spark, path, "k int, v string").collect()


def test_scan_objects(spark, table, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-a")
    (tmp_path / "b.txt").write_bytes(b"no")
    rows = tables.scan_objects(spark, str(tmp_path)).collect()
    assert [(r.size, r.md5_hash, r.content_type) for r in rows] == [
        (6, __import__("hashlib").md5(b"%PDF-a").hexdigest(), "application/pdf")
    ]
    sidecar = table([(rows[0].uri, [("media-id", "7")])], "uri string, metadata array<struct<name:string,value:string>>")
    again = tables.scan_objects(spark, str(tmp_path), sidecar=sidecar).first()
    assert again.metadata[0].value == "7"


def test_write_partitioned_keeps_rows(spark, tmp_path):
    rows = spark.range(1000).select("id", F.expr("date_add(DATE '2024-01-01', int(id % 3))").alias("d"))
    tables.write_partitioned(rows, str(tmp_path / "p"), "d", ["id"])
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 1000 and back.where("d = DATE '2024-01-02'").count() == 333


def test_rules_and_empty(spark, table, tmp_path):
    (tmp_path / "r.csv").write_text("document_type,label_ja,description,sort_order\njournal,日誌,daily,1\n", encoding="utf-8")
    assert tuple(tables.read_rules(spark, str(tmp_path / "r.csv")).first()) == ("journal", "日誌", "daily", 1)
    assert tables.empty_table(spark, tables.SYNC_HISTORY_SCHEMA).count() == 0


def test_backfill(table):
    staged = table([("u1", "d1", dt.datetime(2020, 1, 1)), ("u2", "d2", dt.datetime(2020, 1, 1))],
                   "uri string, document_id string, updated_at timestamp")
    raw = table([("u1", "application/pdf", [("modified_gmt", "2026-01-02T03:04:05")], dt.datetime(2026, 1, 9))],
                "uri string, content_type string, metadata array<struct<name:string,value:string>>, updated timestamp")
    done = state.backfill_updated_at(staged, raw)
    assert {r.uri: r.updated_at for r in done.collect()} == {
        "u1": dt.datetime(2026, 1, 2, 3, 4, 5), "u2": dt.datetime(2020, 1, 1)
    }
    dim = table([("d1", dt.datetime(2000, 1, 1)), ("d9", dt.datetime(2000, 1, 1))], "document_id string, updated_at timestamp")
    assert {r.document_id: r.updated_at.year for r in state.propagate_updated_at(dim, done).collect()} == {"d1": 2026, "d9": 2000}


def test_last_wins(table):
    rows = table([(1, "a", 1, "x"), (1, "b", 2, "y"), (1, "a", 3, "z")], "q int, d string, p int, v string")
    got = {r.d: (r.first_position, r.v) for r in last_wins(rows, ["q"], "d", "p", ["v"]).collect()}
    assert got == {"a": (1, "z"), "b": (2, "y")}


def test_dated_table_rewrites_only_touched_days(spark, table):
    import os

    schema = "k int, v string, day date"
    d = dt.date
    store = DatedTable(spark, scratch_path(spark, "dated"), ["k"], "day", ["k"])
    assert store.read() is None
    store.merge(table([(1, "a", d(2026, 1, 1)), (2, "b", d(2026, 1, 2)), (3, "c", d(2026, 1, 3)), (4, "d", None)], schema))
    before = os.listdir(store.path + "/day=2026-01-03")
    # 1 moves to another day and leaves an empty one, 4 gets a day, 5 is new.
    change = table([(1, "A", d(2026, 1, 2)), (4, "D", d(2026, 1, 2)), (5, "e", d(2026, 1, 4))], schema)
    for _ in range(2):
        got = {r.k: (r.v, str(r.day)) for r in store.merge(change).collect()}
        assert got == {
            1: ("A", "2026-01-02"), 2: ("b", "2026-01-02"), 3: ("c", "2026-01-03"), 4: ("D", "2026-01-02"), 5: ("e", "2026-01-04")
        }
    assert os.listdir(store.path + "/day=2026-01-03") == before
    assert not os.path.exists(store.path + "/day=2026-01-01")
    left = store.merge(table([], schema), drop=table([(3,), (5,)], "k int"))
    assert sorted(r.k for r in left.collect()) == [1, 2, 4]
    assert sorted(r.k for r in store.overwrite(store.read().where("k < 3")).collect()) == [1, 2]


def test_skip_unchanged(table):
    source = table([(1, "a", "x"), (2, "b", "x"), (None, "c", "x"), (3, "d", "x")], "k int, h string, wide string")
    target = table([(1, "a"), (1, "a"), (2, "old")], "k int, h string")
    got = state.skip_unchanged(source, target, ["k", "h"])
    assert sorted((str(r.k), r.h) for r in got.collect()) == [("2", "b"), ("3", "d"), ("None", "c")]


def test_point_reads_skip_row_groups(spark, tmp_path):
    rows = spark.range(60_000).select(F.md5(F.col("id").cast("string")).alias("document_id"), F.col("id"), F.lit("2026-01-01").cast("date").alias("day"))
    wanted = rows.where("id = 31234").first().document_id
    read = {}
    for lookup in ((), ("document_id",)):
        store = state.DatedTable(spark, str(tmp_path / f"t{len(lookup)}"), ["id"], "day", ["id"], lookup)
        spark.conf.set("parquet.block.size", str(256 * 1024))
        store.overwrite(rows.coalesce(1))
        spark.conf.unset("parquet.block.size")
        found = store.read().where(F.col("document_id") == wanted).select("id")
        assert [r.id for r in found.collect()] == [31234]
        read[lookup] = found._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()
    assert read["document_id",] < read[()] / 3


def test_tables_without_rows(spark, tmp_path):
    store = state.DatedTable(spark, str(tmp_path / "t"), ["k"], "day")
    empty = spark.createDataFrame([], "k int, day date, v string")
    assert store.merge(empty).collect() == [] and store.merge(empty).schema == store.read().schema
    assert [r.v for r in store.merge(spark.createDataFrame([(1, None, "x")], "k int, day date, v string")).collect()] == ["x"]


def test_listing_opens_no_file(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"12345")
    sidecar = spark.createDataFrame([(f"file:{tmp_path}/a.pdf", "known", [("n", "v")])], "uri string, md5_hash string, metadata array<struct<name:string,value:string>>")
    listed = tables.scan_objects(spark, str(tmp_path), sidecar=sidecar)
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert [(r.size, r.md5_hash) for r in listed.collect()] == [(5, "known")]
    read = tables.scan_objects(spark, str(tmp_path), sidecar=sidecar, hash_content=True).first()
    assert read.md5_hash == "827ccb0eea8a706c4c34a16891f84e7b" and read.metadata[0].value == "v"


def test_lookup_filters_are_as_small_as_their_days(spark, tmp_path):
    """A filter of its full size took 1 MB a day, whatever the day held."""
    import os

    rows = spark.range(4_000).select(F.md5(F.col("id").cast("string")).alias("token"), F.expr("date_add(DATE '2026-01-01', int(id % 5))").alias("day"))
    store = DatedTable(spark, str(tmp_path / "t"), ["token"], "day", ["token"], ["token"])
    store.merge(rows)
    sizes = [os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(store.path) for f in files if f.endswith(".parquet")]
    assert len(sizes) == 5 and max(sizes) < 100_000


@pytest.mark.parametrize("few", [0, 2, 100])
def test_rows_with_texts_are_told_apart_by_their_keys(table, few):
    from paperloom.operators.relational import near_keys, without_pairs, without_wide

    df = table([(i % 40, None if i % 7 == 0 else f"k{i % 9}", f"text {i}") for i in range(80)], "a int, b string, t string")
    other = table([(i, None if i % 5 == 0 else f"k{i % 4}") for i in range(0, 40, 3)], "a int, b string")
    expected = pairs(without_pairs(df, other, ["a", "b"]).na.fill("-"))
    assert pairs(without_wide(df, other, ["a", "b"], few=few).na.fill("-")) == expected and len(expected) < 80
    assert pairs(without_wide(df, other.selectExpr("cast(a AS bigint) a", "b"), ["a", "b"], few=few).na.fill("-")) == expected
    assert pairs(without_wide(df, other.where("a > 99"), ["a", "b"], few=few).na.fill("-")) == pairs(df.na.fill("-"))
    near = near_keys(df, other, ["a", "b"], few)
    assert pairs(near.na.fill("-")) == (pairs(df.na.fill("-")) if few < 14 else pairs(df.join(other, (df.a == other.a) & df.b.eqNullSafe(other.b), "left_semi").na.fill("-")))


def test_known_texts_follow_not_in(table):
    source = table([(1, "x"), (2, "y"), (None, "z")], "k int, t string")
    for known in ([1], [1, None], [], [5]):
        target = table([(k, "old") for k in known], "k int, t string")
        assert sorted(map(str, state.skip_known_texts(source, target, "k").collect())) == sorted(map(str, state.skip_known(source, target, "k").collect()))


def test_slices_of_a_merge_end_in_the_same_table(spark, table, monkeypatch):
    schema, d = "k int, v string, day date", dt.date
    first = table([(k, "a", None if k % 6 == 5 else d(2026, 1, 1 + k % 6)) for k in range(30)], schema)
    change = table([(k, "B", d(2026, 1, 1 + k % 4)) for k in range(0, 40, 3)], schema)
    got = []
    for size in (1, 1 << 30):
        monkeypatch.setattr(state, "SLICE_BYTES", size)
        store = DatedTable(spark, scratch_path(spark, "sliced"), ["k"], "day", ["k"])
        store.merge(first)
        got.append(sorted(map(str, store.merge(change, drop=table([(1,), (7,)], "k int")).collect())))
    assert got[0] == got[1] and len(got[0]) == 32
