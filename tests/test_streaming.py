import datetime as dt
import json

from paperloom.session import scratch_path
from paperloom.sources.state import DatedTable, KeyedTable
from paperloom.streaming import jobs


def test_ingest_takes_new_files_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    store = KeyedTable(spark, scratch_path(spark, "store"), ["k"])
    checkpoint = str(tmp_path / "checkpoint")

    def put(name, rows):
        (source / name).write_text("\n".join(json.dumps(r) for r in rows))

    def run():
        schema = spark.createDataFrame([], "k int, v string, at bigint").schema
        q = jobs.ingest_stream(spark, str(source), schema, store, checkpoint, newest="at", files_per_batch=1)
        assert q.awaitTermination(120)
        return sorted((r.k, r.v) for r in store.read().collect())

    put("a.json", [{"k": 1, "v": "a", "at": 1}, {"k": 1, "v": "b", "at": 2}, {"k": 2, "v": "c", "at": 1}])
    assert run() == [(1, "b"), (2, "c")]
    put("b.json", [{"k": 2, "v": "d", "at": 5}, {"k": 3, "v": "e", "at": 5}])
    assert run() == [(1, "b"), (2, "d"), (3, "e")]
    assert run() == [(1, "b"), (2, "d"), (3, "e")]


def test_rates(table):
    t0 = dt.datetime(2026, 1, 1)
    rows = table([(t0 + dt.timedelta(seconds=s), 100.0) for s in [0, 10, 20, 59, 60, 130]], "ts timestamp, bytes double")
    got = jobs.rate_alert(rows, "ts", threshold=0.05).collect()
    assert [(r.window_start, r.total) for r in got] == [(t0, 4.0)]
    sums = jobs.rate_alert(rows, "ts", "bytes", 1.0).orderBy("window_start").collect()
    assert [round(r.rate, 3) for r in sums] == [6.667, 1.667, 1.667]


def test_rate_stream_closes_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    base = [f'{{"ts": "2026-01-01T00:00:{s:02d}Z"}}' for s in range(50)]
    (tmp_path / "in" / "a.json").write_text("\n".join(base + ['{"ts": "2026-01-01T01:00:00Z"}']))
    rows = spark.readStream.schema("ts timestamp").json(str(tmp_path / "in"))
    alerts = jobs.rate_alert(rows, "ts", threshold=0.5, late="1 minute")
    q = (
        alerts.writeStream.outputMode("append").format("memory").queryName("alerts")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    assert q.awaitTermination(120)
    assert [(r.total, str(r.window_end)) for r in spark.table("alerts").collect()] == [(50.0, "2026-01-01 00:01:00")]


def test_access_log(table):
    rows = table(
        [("GET", 200, "/a", "trace/span;o=1", 5), ("GET", 404, "/b", "trace", 5), ("GET", 500, "/c", None, 5), ("GET", 302, "/d", ";o=1", 5)],
        "method string, status int, path string, trace_header string, duration_ns bigint",
    )
    got = [(r.level, r.severity, r.trace_id, r.span_id) for r in jobs.project_access_log(rows).collect()]
    assert got == [("info", "INFO", "trace", "span"), ("warn", "WARNING", "trace", None), ("error", "ERROR", None, None), ("info", "INFO", None, None)]
    assert [r.severity for r in rows.select(jobs.severity("status").alias("severity")).collect()] == ["DEFAULT"] * 4


def test_replayed_batch_is_merged_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    store = DatedTable(spark, scratch_path(spark, "store"), ["k"], "day")
    checkpoint = str(tmp_path / "checkpoint")

    def run():
        q = jobs.ingest_stream(spark, str(source), spark.createDataFrame([], "k int, v string, day date").schema, store, checkpoint, files_per_batch=1)
        assert q.awaitTermination(120)
        return sorted((r.k, r.v) for r in store.read().collect())

    for k in range(3):
        (source / f"{k}.json").write_text(json.dumps({"k": k, "v": "a", "day": f"2026-01-0{k + 1}"}))
        run()
    before = {f.name for d in (tmp_path.parent / store.path).glob("day=*") for f in d.iterdir()}
    ledger = jobs.BatchLedger(spark, f"{checkpoint}-ledger")
    assert sorted(r.batch for r in ledger.read().collect()) == [0, 1, 2] and ledger.has(2) and not ledger.has(3)
    for f in (tmp_path / "checkpoint" / "commits").glob("*2*"):  # the run ended before the last batch was committed
        f.unlink()
    assert run() == [(0, "a"), (1, "a"), (2, "a")]
    assert {f.name for d in (tmp_path.parent / store.path).glob("day=*") for f in d.iterdir()} == before  # nothing was written again


def test_alerts_are_withdrawn(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    t0 = "2026-01-01T00:00:%02dZ"
    stores = KeyedTable(spark, scratch_path(spark, "alerts"), ["window_start"]), DatedTable(spark, scratch_path(spark, "alerts"), ["window_start"], "day")

    def run(values, name):
        (source / name).write_text("\n".join(json.dumps({"ts": t0 % s, "bytes": v}) for s, v in values))
        rows = spark.readStream.schema("ts timestamp, bytes double").json(str(source))
        for k, store in enumerate(stores):
            assert jobs.alert_stream(rows, "ts", store, str(tmp_path / f"cp{k}"), "bytes", 1.0).awaitTermination(120)
        found = [[(r.total, r.rate) for r in store.read().collect()] for store in stores]
        assert found[0] == found[1]
        return found[0]

    assert run([(1, 50.0), (30, 30.0)], "a.json") == [(80.0, 80 / 60)]
    assert run([(5, -40.0)], "b.json") == []  # fell back
    assert run([(6, 100.0)], "c.json") == [(140.0, 140 / 60)]


def test_closed_alerts_wait_for_the_watermark(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = KeyedTable(spark, scratch_path(spark, "alerts"), ["window_start"])

    def run(name, times):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"ts": t}) for t in times))
        rows = spark.readStream.schema("ts timestamp").json(str(tmp_path / "in"))
        assert jobs.alert_stream(rows, "ts", store, str(tmp_path / "cp"), threshold=0.5, late="1 minute", closed=True).awaitTermination(120)
        found = store.read()
        return [] if found is None else [r.total for r in found.collect()]

    assert run("a.json", [f"2026-01-01T00:00:{s:02d}Z" for s in range(40)]) == []
    assert run("b.json", [f"2026-01-01T00:00:{s:02d}Z" for s in range(40, 50)] + ["2026-01-01T00:01:30Z"]) == []
    assert run("c.json", ["2026-01-01T01:00:00Z"]) == [50.0]
