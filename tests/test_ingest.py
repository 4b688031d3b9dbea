import datetime as dt

from pyspark.sql import functions as F

from paperloom.functions.metadata import meta_value
from paperloom.operators import ingest

MEDIA = "id bigint, date timestamp, modified_gmt timestamp, title string, mime_type string, source_url string, post bigint"


def media(table, rows):
    full = []
    for r in rows:
        at = dt.datetime.fromisoformat(r.get("at", "2026-03-15T09:00:00"))
        full.append(
            (r["id"], dt.datetime.fromisoformat(r.get("date", "2026-03-15T00:00:00")), at, r.get("title", "t"),
             r.get("mime", "application/pdf"), r.get("url", f"https://example.com/{r['id']}.pdf"), r.get("post", 1))
        )
    return table(full, MEDIA)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_latest_attachment(table):
    old, new = {"id": 2807, "at": "2026-03-15T09:46:19"}, {"id": 2808, "at": "2026-03-15T09:55:17"}
    assert ids(ingest.latest_attachment(media(table, [old, new]))) == [2808]
    assert ids(ingest.latest_attachment(media(table, [new, old]))) == [2808]
    assert ids(ingest.latest_attachment(media(table, []))) == []
    assert ids(ingest.latest_attachment(media(table, [{"id": 2}, {"id": 1}]))) == [1]


def test_dedupe_titles(table):
    three = [{"id": i, "title": t} for i, t in enumerate("abc")]
    assert ids(ingest.dedupe_titles(media(table, three))) == [0, 1, 2]
    same = [{"id": 1, "title": "a/b", "at": "2026-03-15T09:00:00"}, {"id": 2, "title": "ab", "at": "2026-03-15T10:00:00"}]
    assert ids(ingest.dedupe_titles(media(table, same))) == [2]
    assert ids(ingest.dedupe_titles(media(table, [*same, {"id": 3, "title": "c"}]))) == [2, 3]


def test_object_path(table):
    rows = media(table, [
        {"id": 2840, "date": "2026-03-15T00:00:00", "title": "2026年度バレエ教室プリエ募集"},
        {"id": 100, "date": "2026-05-01T00:00:00", "title": "テスト"},
    ])
    got = [r.p for r in rows.select(ingest.object_path().alias("p"), "id").orderBy(F.desc("id")).collect()]
    assert got == ["web/2026/03/2840_2026年度バレエ教室プリエ募集.pdf", "web/2026/05/100_テスト.pdf"]


def test_object_metadata(table):
    row = media(table, [{"id": 5, "url": "https://example.com/files/園.pdf", "post": 9}]).select(
        ingest.object_metadata().alias("m")
    ).first()
    assert [(m.name, m.value) for m in row.m] == [
        ("original-filename", "%E5%9C%92.pdf"),
        ("source-url", "https://example.com/files/園.pdf"),
        ("letter-id", "9"),
        ("media-id", "5"),
        ("modified_gmt", "2026-03-15T09:00:00"),
    ]


def test_backfill_statuses(table):
    objects = table(
        [("new", [("media-id", "1")]), ("gone", [("media-id", "2")]), ("drive", [("drive-file-id", "d")]),
         ("done", [("media-id", "1"), ("modified_gmt", "2026-01-01T00:00:00")]), ("bare", [])],
        "uri string, metadata array<struct<name:string,value:string>>",
    )
    patched = ingest.metadata_backfill(objects, media(table, [{"id": 1}]))
    assert {r.uri: r.outcome for r in patched.collect()} == {
        "new": "uploaded", "gone": "error", "drive": "skipped", "done": "skipped", "bare": "skipped"
    }
    assert tuple(ingest.outcome_counts(patched).first()) == (1, 3, 1, 5)
    grown = ingest.apply_backfill(patched).select("uri", meta_value("metadata", "modified_gmt").alias("t"))
    assert {r.uri: r.t for r in grown.collect()} == {
        "new": "2026-03-15T09:00:00", "gone": None, "drive": None, "done": "2026-01-01T00:00:00", "bare": None
    }


def test_upload_outcome(table):
    rows = table([(False, None), (True, None), (False, True)], "skipped boolean, error boolean")
    assert tuple(ingest.outcome_counts(rows.withColumn("outcome", ingest.upload_outcome())).first()) == (1, 1, 1, 3)


def test_ingest_plan(table):
    letters = table(
        [(1, dt.datetime(2026, 3, 20)), (2, dt.datetime(2026, 3, 1)), (3, dt.datetime(2026, 3, 21))],
        "id bigint, modified timestamp",
    )
    feed = media(table, [
        {"id": 10, "post": 1, "title": "a"}, {"id": 11, "post": 1, "title": "b", "at": "2026-03-16T09:00:00"},
        {"id": 20, "post": 2, "title": "old letter"}, {"id": 30, "post": 3, "title": "stored"},
        {"id": 31, "post": 3, "title": "picture", "mime": "image/png", "at": "2026-03-17T09:00:00"},
    ])
    stored = table([("web/2026/03/30_stored.pdf",)], "object_path string")
    assert ids(ingest.ingest_plan(letters, feed, stored, "2026-03-10")) == [11]
    assert ids(ingest.ingest_plan(letters, feed, stored, "2026-03-10", per_title=True)) == [10, 11]
    assert [r.id for r in ingest.modified_after(letters, "2026-03-10").collect()] == [3, 1]


def test_attachments_query_takes_media_of_all_letters(spark, tmp_path):
    """Letters are not cut by date: page 1 is of 2024-01-06, page 3 of 2024-01-17."""
    from paperloom.queries import catalog

    html = "<title>t</title>"
    pages = [(1, "https://a.example/11", html), (3, "https://a.example/12", html), (4, "http://a.example/11", html)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = catalog.queries()["attachments"](spark, str(tmp_path)).collect()
    assert sorted(r["id"] for r in rows) == [1, 3]
