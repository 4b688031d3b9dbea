import datetime as dt
import hashlib
import json

from pyspark.sql import functions as F

from paperloom.operators import marts

EVENT = """event_id string, document_id string, event_date date, event_time string, event_title string,
    event_description string"""


def test_extract_events(table):
    result = {"events": [
        {"event_date": "2026-04-01", "event_time": "9:05", "event_title": "入園式", "event_description": "短い"},
        {"event_date": "2026-04-01", "event_time": "9:05", "event_title": "入園式", "event_description": "もっと長い説明"},
        {"event_date": "2026-4-7", "event_time": "25:00", "event_title": "遠足", "event_description": "x"},
        {"event_date": "2026-02-30", "event_time": None, "event_title": "幻", "event_description": "x"},
        {"event_date": "2026-05-01", "event_time": None, "event_title": " 　", "event_description": "x"},
        {"event_date": "2026-05-02", "event_time": None, "event_title": "運動会", "event_description": None},
    ]}
    rows = table([("d", json.dumps(result)), ("e", '{"events": []}'), ("f", "oops")], "document_id string, llm_result string")
    got = {r.event_title: r for r in marts.extract_events(rows, F.current_timestamp()).collect()}
    assert set(got) == {"入園式", "遠足", "運動会"}
    first = got["入園式"]
    assert (first.event_description, first.event_time, first.event_date) == ("もっと長い説明", "09:05", dt.date(2026, 4, 1))
    assert first.event_id == hashlib.md5("d2026-04-019:05入園式".encode()).hexdigest()
    assert got["遠足"].event_time is None and got["遠足"].event_date == dt.date(2026, 4, 7)
    assert got["運動会"].event_time is None and got["運動会"].event_description is None


def events(table):
    return table(
        [("abc123", "doc1", dt.date(2026, 4, 17), "10:00", "入園式", "9時\n集合"),
         ("def456", "doc1", dt.date(2026, 5, 1), None, "春の遠足", None),
         ("late", "doc2", dt.date(2026, 4, 17), None, "a&b", "c d"),
         ("past", "doc2", dt.date(2026, 4, 2), "23:30", "p", "q"),
         ("old", "doc2", dt.date(2026, 3, 31), "08:00", "p", "q"),
         ("done", "doc2", dt.date(2026, 4, 3), "08:00", "p", "q")],
        EVENT,
    )


def test_upcoming_order(table):
    got = [r.event_id for r in marts.upcoming_events(events(table), "2026-04-17").collect()]
    assert got == ["abc123", "late", "def456"]


def test_events_with_sync(table):
    documents = table([("doc1", "園だより", "journal", dt.date(2026, 4, 1))],
                      "document_id string, title string, document_type string, publish_date date")
    history = table([("done", "c1", dt.datetime(2026, 4, 3), "x"), ("abc123", "c2", dt.datetime(2026, 4, 4), "x")],
                    "event_id string, calendar_event_id string, synced_at timestamp, synced_by string")
    rows = events(table).withColumn("extracted_at", F.current_timestamp())
    synced = marts.events_with_sync(rows, documents, history, "2026-04-17")
    got = {r.event_id: r for r in synced.collect()}
    assert set(got) == {"abc123", "def456", "late", "past"}  # old: last month; done: past and synced
    assert got["abc123"].calendar_event_id == "c2" and got["abc123"].document_title == "園だより"
    exported = {r.event_id: r for r in marts.export_events(synced).collect()}
    assert exported["abc123"].synced_at == "2026-04-04T00:00:00Z" and exported["late"].synced_at is None
    assert exported["abc123"].event_date == "2026-04-17"


def test_ical_text(table):
    got = {r.event_id: r.t for r in events(table).select("event_id", marts.ical_text("-//x//EN", "x").alias("t")).collect()}
    assert got["abc123"] == (
        "BEGIN:VCALENDAR\nVERSION:2.0\nPRODID:-//x//EN\nCALSCALE:GREGORIAN\nBEGIN:VEVENT\nUID:abc123@x\nSUMMARY:入園式\n"
        "DESCRIPTION:9時\\n集合\nDTSTART;TZID=Asia/Tokyo:20260417T100000\nDTEND;TZID=Asia/Tokyo:20260417T110000\n"
        "END:VEVENT\nEND:VCALENDAR"
    )
    assert "DTSTART;VALUE=DATE:20260501\nDTEND;VALUE=DATE:20260502\n" in got["def456"] and "DESCRIPTION:\n" in got["def456"]
    assert "DTSTART;TZID=Asia/Tokyo:20260402T233000\nDTEND;TZID=Asia/Tokyo:20260402T003000\n" in got["past"]


def test_calendar_link(table):
    got = {r.event_id: r.u for r in events(table).select("event_id", marts.calendar_link().alias("u")).collect()}
    assert got["past"].endswith("?action=TEMPLATE&text=p&dates=20260402T233000%2F20260402T003000&details=q&ctz=Asia%2FTokyo")
    assert "text=a%26b&dates=20260417%2F20260418&details=c+d" in got["late"]


def documents(table):
    return table(
        [("a", "t1", "journal", dt.date(2026, 3, 1), dt.datetime(2026, 3, 2), 500),
         ("b", "t2", "journal", dt.date(2026, 4, 1), dt.datetime(2026, 1, 2), 2048),
         ("c", "t3", None, None, dt.datetime(2026, 5, 2), 10),
         ("d", "t4", "", None, dt.datetime(2026, 6, 2), 10),
         ("e", "t5", "photo_album", dt.date(2026, 3, 1), dt.datetime(2026, 9, 2), 3 * 1024 * 1024)],
        "document_id string, title string, document_type string, publish_date date, updated_at timestamp, size bigint",
    )


def test_listing(table):
    docs = documents(table)
    assert [r.document_id for r in marts.sort_documents(docs).collect()] == ["b", "a", "e", "d", "c"]
    assert [r.document_id for r in marts.sort_documents(docs, "journal").collect()] == ["b", "a"]
    assert [r.document_type for r in marts.facet(docs, "document_type").collect()] == ["journal", "photo_album"]
    assert [r.document_id for r in marts.list_page(docs, limit=2, offset=1).collect()] == ["a", "e"]
    assert [r.document_id for r in marts.list_page(docs, "journal", "2026-03-15", "2026-04-15").collect()] == ["b"]
    cards = {r.document_id: r for r in marts.document_cards(docs.withColumn("total_chunks", F.lit(1))).collect()}
    assert (cards["a"].type_label, cards["a"].size_label, cards["a"].date_label) == ("日誌", "500 B", "2026年3月1日")
    assert cards["c"].date_label == "2026年5月2日" and cards["e"].size_label == "3.0 MB"


def test_list_recent(table):
    raw = table([(f"u{i:03d}", i, "application/pdf", 1, dt.datetime(2026, 1, 1) + dt.timedelta(hours=i)) for i in range(150)],
                "uri string, generation bigint, content_type string, size bigint, updated timestamp")
    got = marts.list_recent(raw).collect()
    assert len(got) == 100 and got[0].uri == "u149" and got[0].generation == "149" and got[0].updated == "2026-01-07T05:00:00Z"


def test_document_detail_continues_in_parts(table):
    chunks = table([("a", i, f"c{i}", f"text {i}") for i in range(25)],
                   "document_id string, chunk_index bigint, chunk_id string, chunk_text string")
    rows = marts.document_detail(documents(table), chunks.repartition(4), part_size=10).orderBy("document_id", "part").collect()
    a = [r for r in rows if r.document_id == "a"]
    assert [r.part for r in a] == [0, 1, 2]
    assert [c.chunk_index for r in a for c in r.chunks] == list(range(25))
    assert [len(r.chunks) for r in rows if r.document_id != "a"] == [0, 0, 0, 0]


def test_stage_texts(table):
    meta = [("media-id", "7"), ("original-filename", "%E5%9C%92.pdf")]
    ok, bad = json.dumps({"extracted_markdown": "# a"}), json.dumps({"other": 1})
    rows = table(
        [("u1", "application/pdf", 1, "h", meta, dt.datetime(2026, 1, 1), ok, ""),
         ("u2", "application/pdf", 1, "h", meta, dt.datetime(2026, 1, 1), bad, ""),
         ("u3", "application/pdf", 1, "h", meta, dt.datetime(2026, 1, 1), ok, "RETRY")],
        """uri string, content_type string, size bigint, md5_hash string, metadata array<struct<name:string,value:string>>,
        updated timestamp, llm_result string, status string""",
    )
    got = marts.stage_texts(rows).collect()
    assert [(r.uri, r.document_id, r.original_filename, r.extracted_markdown) for r in got] == [("u1", "7", "園.pdf", "# a")]


def test_pages_by_seeking(table):
    days = ["2026-01-02", "2026-01-01", None]
    rows = [(f"d{k:02d}", "journal" if k % 4 else "other", dt.date.fromisoformat(days[k % 3]) if days[k % 3] else None) for k in range(30)]
    df = table(rows, "document_id string, document_type string, publish_date date")
    for kind in (None, "journal"):
        last, walked = None, []
        while True:
            page = marts.list_after(df, last, kind, limit=4).collect()
            if not page:
                break
            walked += [r.document_id for r in page]
            last = page[-1].publish_date, page[-1].document_id
        assert walked == [r.document_id for r in marts.list_page(df, kind, limit=100).collect()]


def test_longest_events_without_a_shuffle(spark, table):
    from pyspark.sql import functions as F

    def event(day, clock, title, text):
        return {"event_date": day, "event_time": clock, "event_title": title, "event_description": text}

    one = [event("2026-04-01", None, "a", "x"), event("2026-04-01", "", "a", "longer"), event("2026-04-01", "9:00", "a", None), event("2026-04-01", "9:00", "a", ""),
           event("bad", None, "a", "x"), event("2026-04-02", None, " ", "x"), event("2026-04-02", None, "b", "same2"), event("2026-04-02", None, "b", "same1")]
    rows = table([("d1", json.dumps({"events": one})), ("d2", json.dumps({"events": one[:1]})), ("d3", "{}"), ("d4", None)], "document_id string, llm_result string")
    at = F.lit("2026-01-01").cast("timestamp")
    got = marts.extract_events(rows, at, unique_ids=True)
    key = lambda r: (r.document_id, str(r.event_date), r.event_title, r.event_time or "", r.event_description or "")
    want = [("d1", "2026-04-01", "a", "", "longer"), ("d1", "2026-04-01", "a", "09:00", ""), ("d1", "2026-04-02", "b", "", "same1"), ("d2", "2026-04-01", "a", "", "x")]
    assert sorted(map(key, got.collect())) == sorted(want) == sorted(map(key, marts.extract_events(rows, at).collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    twice = rows.unionByName(table([("d1", json.dumps({"events": [event("2026-04-01", None, "a", "the longest")]}))], "document_id string, llm_result string"))
    assert "the longest" in {r.event_description for r in marts.extract_events(twice, at).collect()}
