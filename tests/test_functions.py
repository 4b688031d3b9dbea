import pytest
from pyspark.sql import functions as F

from paperloom.functions import dates, json
from paperloom.functions import text as X
from paperloom.functions.metadata import meta_value, stored_document_id


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(build("c").alias("x")).first().x


@pytest.mark.parametrize(
    "name, clean",
    [("test/file", "testfile"), ("test\\file", "testfile"), ("file:name", "filename"), ("file*name", "filename"),
     ("file?name", "filename"), ("file<name>", "filename"), ("file|name", "filename"), ('file"name', "filename"),
     ("2026年&amp;令和8年", "2026年&令和8年"), ("&lt;テスト&gt;", "テスト"), ("&quot;テスト&quot;", "テスト"),
     ("a&#039;b", "a'b"), ("&amp;lt;x", "x")],
)
def test_safe_file_name(spark, name, clean):
    assert one(spark, name, X.safe_file_name) == clean


def test_url_codecs(spark):
    raw = "https://example.com/files/園だより 4月+(1)!.pdf"
    coded = one(spark, raw, X.original_filename)
    assert coded == "%E5%9C%92%E3%81%A0%E3%82%88%E3%82%8A%204%E6%9C%88%2B(1)!.pdf"
    assert one(spark, "https://example.com/files/" + coded, X.original_filename) == coded
    assert one(spark, "https://example.com/files/document.pdf", X.original_filename) == "document.pdf"
    assert one(spark, coded, X.percent_decode) == "園だより 4月+(1)!.pdf"
    assert one(spark, "a+b%20c", X.percent_decode) == "a+b c"
    assert one(spark, "%zz", lambda c: X.percent_decode(c, strict=False)) is None
    assert one(spark, "a b*~", X.form_encode) == "a+b*%7E"


def test_paths(spark):
    assert one(spark, "gs://b/web/2026/x.pdf", X.last_segment) == "x.pdf"
    assert one(spark, "nothing", X.last_segment) is None
    assert one(spark, "gs://b/web/2026/x.pdf", X.uri_bucket) == "b"
    assert one(spark, "gs://b/web/2026/x.pdf", X.uri_key) == "web/2026/x.pdf"
    assert one(spark, "s3://b/x", X.uri_bucket) is None


def test_unicode_whitespace(spark):
    assert one(spark, "　  a b \n", X.ws_trim) == "a b"
    assert one(spark, "給食 献立", X.tokens) == ["給食", "献立"]
    assert one(spark, "  給食　　献立  ", X.tokens) == ["給食", "献立"]
    assert one(spark, "", X.tokens) == [] and one(spark, "　 ", X.tokens) == []


@pytest.mark.parametrize(
    "size, label",
    [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.3 KB"), (1024 * 1024 - 1, "1024.0 KB"),
     (1024 * 1024, "1.0 MB"), (5_500_000, "5.2 MB")],
)
def test_byte_size(spark, size, label):
    assert one(spark, size, X.byte_size_label, "bigint") == label


def test_type_label(spark):
    assert one(spark, "monthly_lunch_info", X.type_label) == "給食便り"
    assert one(spark, "poem", X.type_label) == "poem" and one(spark, None, X.type_label) is None


@pytest.mark.parametrize(
    "text, day",
    [("2026-04-01", "2026-04-01"), ("2026-4-7", "2026-04-07"), (" 2026-04-01 ", "2026-04-01"), ("2026-02-30", None),
     ("2026/04/01", None), ("", None), (None, None), ("soon", None)],
)
def test_safe_date(spark, text, day):
    got = one(spark, text, dates.safe_date)
    assert (str(got) if got else None) == day


@pytest.mark.parametrize(
    "text, clock", [("9:05", "09:05"), ("23:30", "23:30"), ("25:00", None), ("10:60", None), ("noon", None), (None, None)]
)
def test_safe_clock(spark, text, clock):
    assert one(spark, text, dates.safe_clock) == clock


def test_clock_and_labels(spark):
    assert one(spark, "23:30", lambda c: dates.add_minutes(c, 60)) == "00:30"
    day = spark.sql("SELECT DATE '2026-04-01' AS c")
    assert day.select(dates.date_label("c").alias("x")).first().x == "2026年4月1日"
    assert day.select(dates.padded_date_label("c").alias("x")).first().x == "2026年04月01日"


def test_json_scalars(spark):
    text = '{"a": "x", "b": {"c": 1}, "d": [1], "e": "[重要] 連絡", "f": "{x}", "g": 1.5, "h": null, "i": true}'
    got = one(spark, text, lambda c: json.scalars(c, list("abdefghiz")))
    assert got.asDict() == {
        "a": "x", "b": None, "d": None, "e": "[重要] 連絡", "f": "{x}", "g": "1.5", "h": None, "i": "true", "z": None
    }
    assert one(spark, '{"a": ', lambda c: json.scalars(c, ["a"])).a is None


def test_json_objects(spark):
    def build(c):
        return json.objects(c, "events", ["t", "d"])

    assert [tuple(e) for e in one(spark, '{"events": [{"t": "[a]", "d": {"x": 1}}, {"t": "b"}]}', build)] == [
        ("[a]", None), ("b", None)
    ]
    assert one(spark, '{"events": []}', build) == []
    assert one(spark, '{"events": "none"}', build) is None and one(spark, "{}", build) is None
    mixed = one(spark, '{"events": [1, {"t": "b", "d": "c"}]}', build)
    assert [tuple(e) for e in mixed] == [(None, None), ("b", "c")]


def test_metadata(spark):
    rows = spark.createDataFrame(
        [([("media-id", "7"), ("drive-file-id", "d")],), ([("media-id", "7")],), ([],)],
        "m array<struct<name:string,value:string>>",
    )
    got = rows.select(stored_document_id("m").alias("x")).collect()
    assert [r.x for r in got] == ["d", "7", None]
    twice = spark.createDataFrame([([("a", "1"), ("a", "2")],)], "m array<struct<name:string,value:string>>")
    with pytest.raises(Exception, match="several values"):
        twice.select(meta_value("m", "a")).collect()


def test_md5_id_is_null_with_a_null_part(spark):
    assert one(spark, None, lambda c: X.md5_id(c, F.lit("x"))) is None
    assert one(spark, "1", lambda c: X.md5_id(c, F.lit("11"))) == one(spark, "11", lambda c: X.md5_id(c, F.lit("1")))


def test_registered_functions(spark):
    from paperloom.functions.sql import register

    register(spark)
    row = spark.sql(
        "SELECT size(split_by_headings('イントロ\\n*見出し*\\nコンテンツ')) AS n, percent_decode('a+b%20c') AS d, "
        "trim_unicode('\u3000x ') AS t, chunk_id('1', 11) = chunk_id('11', 1) AS same"
    ).first()
    assert tuple(row) == (2, "a+b c", "x", True)


def test_random_id(spark):
    assert spark.range(50).select(X.random_id().alias("u")).distinct().count() == 50
