import datetime as dt

import pytest
from pyspark.sql import functions as F

from paperloom.operators import infer, marts, quality
from paperloom.plans.build import Build, Models
from paperloom.session import scratch_path
from paperloom.sources import tables

RAW = """uri string, generation bigint, content_type string, size bigint, md5_hash string,
    metadata array<struct<name:string,value:string>>, updated timestamp, body string"""


def raw(table, docs, suffix=""):
    rows = []
    for i, text in docs.items():
        meta = [("media-id", str(i)), ("original-filename", f"journal%20{i}%202026-3-{i % 28 + 1}.pdf")]
        rows.append((f"gs://s/{i}.pdf", i, "application/pdf", 10, f"hash{i}{suffix}", meta, dt.datetime(2026, 3, 1, i % 24), text))
    return table(rows, RAW)


def text(i):
    return f"はじめの段落の文章です {i}\n\n●お知らせの内容 {i}\n\n2026-04-{i % 28 + 1:02d} 10:00 行事 {i}"


@pytest.fixture
def build(spark, table):
    rules = table([("journal", "日誌", "daily", 1), ("uncategorized", "その他", "rest", 2)],
                  "document_type string, label_ja string, description string, sort_order bigint")
    models = Models(infer.EchoExtractor(), infer.KeywordClassifier({"journal": "journal"}), infer.DatedLineExtractor(), infer.HashingEmbedder(8))
    return lambda dated=True: Build(spark, scratch_path(spark, "build"), rules, models, dated=dated)


def run(b, rows, **options):
    b.run(rows, "2026-04-01", "body", extracted_at=F.lit("2026-03-01").cast("timestamp"), unique_ids=True, **options)


def snapshot(b):
    out = {}
    for name in ("staged", "chunks", "embedded", "documents", "events", "search_chunks", "synced_events"):
        rows = getattr(b, name).read().drop("updated_day")
        out[name] = sorted(str(sorted(r.asDict().items())) for r in rows.collect())
    return out


def test_incremental_run_equals_full_run(build, table):
    docs = {i: text(i) for i in range(1, 9)}
    whole = build(dated=False)
    run(whole, raw(table, docs))
    parts = build(dated=True)
    run(parts, raw(table, {i: docs[i] for i in range(1, 5)}))
    run(parts, raw(table, docs))
    got, expected = snapshot(parts), snapshot(whole)
    assert got == expected
    assert whole.chunks.read().count() == 16 and whole.events.read().count() == 8
    results = quality.run_checks(whole.checks())
    assert results.where("status = 'fail'").collect() == []


def test_changed_files(build, table):
    docs = {i: text(i) for i in range(1, 4)}
    b = build()
    run(b, raw(table, docs))
    edited = dict(docs) | {2: "まったく新しい文章になりました"}
    run(b, raw(table, edited, "v2"))
    assert "新しい" not in "".join(r.chunk_text for r in b.chunks.read().collect())  # known files are skipped
    run(b, raw(table, edited, "v2"), refresh_changed=True)
    got = [r.chunk_text for r in b.chunks.read().where("document_id = '2'").collect()]
    assert got == ["まったく新しい文章になりました"]
    assert b.embedded.read().count() == b.chunks.read().count() == b.search_chunks.read().count()
    full = build()
    run(full, raw(table, edited, "v2"), full_refresh=True)
    assert snapshot(full)["chunks"] == snapshot(b)["chunks"]
    assert snapshot(full)["documents"] == snapshot(b)["documents"]
    assert snapshot(full)["events"] == snapshot(b)["events"]
    assert snapshot(full)["synced_events"] == snapshot(b)["synced_events"]


def test_edited_dates_reach_events(build, table):
    docs = {1: text(1), 2: "2026-04-02 10:00 遠足のお知らせ", 3: text(3)}
    b = build()
    run(b, raw(table, docs))
    edited = dict(docs) | {2: "2026-04-20 10:00 遠足は延期です"}
    run(b, raw(table, edited, "v2"), refresh_changed=True)
    for t in (b.events, b.synced_events):
        assert [str(r.event_date) for r in t.read().where("document_id = '2'").collect()] == ["2026-04-20"]
    assert b.events.read().count() == 3


def test_window_and_exports(spark, build, table, tmp_path):
    b = build()
    run(b, raw(table, {i: text(i) for i in range(1, 9)}), start="2026-03-01 02:00:00", end="2026-03-01 05:00:00")
    assert sorted(r.document_id for r in b.documents.read().collect()) == ["2", "3", "4"]
    b.export(str(tmp_path), product="-//x//EN")
    events = tables.read_ndjson(spark, str(tmp_path / "events"), "event_id string, ical_content string, event_date string")
    assert events.count() == 3 and events.where("ical_content like '%PRODID:-//x//EN%'").count() == 3
    chunks = tables.read_ndjson(spark, str(tmp_path / "chunks"), "chunk_id string, title string, publish_date string")
    assert chunks.count() == 6 and chunks.where("publish_date like '2026-03-%'").count() == 6
    assert tables.read_ndjson(spark, str(tmp_path / "documents"), "document_id string").count() == 3
    assert b.index() is None  # too few rows
    detail = marts.document_detail(b.documents.read(), b.chunks.read()).where("document_id = '3'").first()
    assert [c.chunk_index for c in detail.chunks] == [0, 1]
    assert tables.read_document_text(b.staged.read(), "3").first().extracted_markdown == text(3)


@pytest.mark.parametrize("dated", [True, False])
def test_postings_follow_the_chunks_and_older_versions_go(build, table, dated):
    import os

    from paperloom.operators.search import text_postings

    docs = {i: text(i) for i in range(1, 5)}
    b = build(dated=dated)
    run(b, raw(table, docs))
    edited = dict(docs) | {2: "まったく新しい文章 になりました", 3: docs[3] + "\n\n●さらに 長くなりました"}
    run(b, raw(table, edited, "v2"), refresh_changed=True)
    places = ["document_id", "chunk_index", "publish_date"]
    expected = text_postings(b.search_chunks.read(), places, "chunk_text")
    rows = lambda df: sorted(str(r) for r in df.select("token", *places).collect())
    assert rows(b.postings.read()) == rows(expected) and b.postings.read().count() > 8
    assert set(b.postings.read().columns) == {"token", *places}  # an id of 32 characters a word is more than the texts
    if not dated:
        assert all(len(t._versions()) == 1 for t in (b.staged, b.chunks, b.embedded, b.search_chunks, b.postings))
