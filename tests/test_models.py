import datetime as dt
import json

from pyspark.sql import functions as F

from paperloom import fixed
from paperloom.operators import compare, infer, quality


def test_inference_runs_once_per_row(spark, tmp_path):
    """A filter on the status does not repeat the call."""

    class Counting:
        def generate(self, prompts, spec):
            with open(str(tmp_path / "calls"), "a") as f:
                f.write("x" * len(prompts))
            return [('{"extracted_markdown": "t"}', "" if i % 2 else "RETRY") for i, _ in enumerate(prompts)]

    rows = infer.infer_text(spark.range(20).select(F.col("id").cast("string").alias("p")), "p", Counting(), infer.EXTRACTION)
    rows.where("status = ''").select("llm_result", "status").collect()
    assert len((tmp_path / "calls").read_text()) == 20


def test_offline_models(table):
    rows = table([("園だより 2026-4-7.pdf",), ("other",)], "title string")
    rules = table([("journal", "日誌", "daily", 2), ("photo_album", "p", "pictures", 1)],
                  "document_type string, label_ja string, description string, sort_order bigint")
    assert infer.rules_text(rules).first().rules_text == "- photo_album: pictures\n- journal: daily"
    asked = infer.with_classification_prompt(rows, rules)
    assert asked.where("title = 'other'").first().prompt == (
        fixed.CLASSIFICATION_PROMPT_HEAD + "other\n\n文書種別の定義:\n- photo_album: pictures\n- journal: daily"
    )
    model = infer.KeywordClassifier({"園だより": "monthly_announcement"})
    got = infer.infer_text(asked, "prompt", model, infer.CLASSIFICATION)
    bodies = {r.title: json.loads(r.llm_result) for r in got.collect()}
    assert bodies["園だより 2026-4-7.pdf"] == {"document_type": "monthly_announcement", "publish_date": "2026-4-7"}
    assert bodies["other"]["document_type"] == "uncategorized"


def test_event_prompt_and_lines(table):
    staged = table([("d", "2026年4月7日 10:00 始業式\nなし\n2026-05-01 遠足", dt.datetime(2026, 3, 1))],
                   "document_id string, extracted_markdown string, updated_at timestamp")
    docs = table([], "document_id string, publish_date date")
    asked = infer.with_event_prompt(staged, docs)
    assert asked.first().prompt.startswith("# 文書情報\nこの文書の発行日: 2026年03月01日\n\n# 和暦→西暦変換ルール\n")
    out = infer.infer_text(asked, "prompt", infer.DatedLineExtractor(), infer.EVENTS).first()
    assert [(e["event_date"], e["event_time"], e["event_title"]) for e in json.loads(out.llm_result)["events"]] == [
        ("2026-4-7", "10:00", "始業式"), ("2026-05-01", None, "遠足")
    ]


def test_embedder(table):
    rows = infer.infer_embedding(table([("a b c",), ("a b c",), ("",)], "t string"), "t", infer.HashingEmbedder(16))
    got = [r.chunk_embedding for r in rows.collect()]
    assert got[0] == got[1] and len(got[0]) == 16 and got[2] is None
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-5


def test_validation(table):
    cases = [
        ('{"document_type": "journal", "publish_date": null}', None), ('{"publish_date": "x"}', "missing document_type"),
        ('{"document_type": "poem"}', "unknown document_type"), ("{", "malformed"), (None, "malformed"),
        ('{"document_type": {"a": 1}}', "missing document_type"),
    ]
    got = infer.validate_result(table([(c,) for c, _ in cases], "llm_result string"), infer.CLASSIFICATION)
    assert [r.problem for r in got.collect()] == [p for _, p in cases]
    arrays = table([('{"events": []}',), ('{"events": 3}',), ("{}",)], "llm_result string")
    assert [r.is_valid for r in infer.validate_result(arrays, infer.EVENTS).collect()] == [True, False, True]


def test_parse_classification(table):
    cols = "document_id string, uri string, title string, content_type string, size bigint, md5_hash string, " \
           "total_chunks bigint, updated_at timestamp, llm_result string, status string"
    def row(i, result, status=""):
        return (i, "u", "t", "c", 1, "h", 1, dt.datetime(2026, 3, 2, 1), result, status)
    rows = table([row("a", '{"document_type": "journal", "publish_date": "2026-1-5"}'),
                  row("b", '{"document_type": "journal", "publish_date": "soon"}'), row("c", None, "RETRY")], cols)
    got = {r.document_id: r.publish_date for r in infer.parse_classification(rows).collect()}
    assert got == {"a": dt.date(2026, 1, 5), "b": dt.date(2026, 3, 2)}


RUN = "document_id string, llm_result string"


def test_compare_classification(table):
    a = table([(d, json.dumps({"document_type": t, "publish_date": "2026-01-01"})) for d, t in [("1", "x"), ("2", "y"), ("3", "z")]], RUN)
    b = table([(d, json.dumps({"document_type": t})) for d, t in [("1", "x"), ("2", "n"), ("4", "z")]], RUN)
    rows = compare.compare_classification(a, b).collect()
    assert [(r.document_id, r.type_match) for r in rows] == [("2", False), ("1", True)]
    agreed = compare.classification_agreement(compare.compare_classification(a, b)).first()
    assert (agreed.n_documents, agreed.n_matching, agreed.agreement, agreed.accepted) == (2, 1, 0.5, False)


def test_compare_text_length(table):
    def side(texts):
        return table([(u, json.dumps({"extracted_markdown": t}), s) for u, t, s in texts], "uri string, llm_result string, status string")
    a = side([("1", "x" * 100, ""), ("2", "x" * 100, ""), ("3", "", ""), ("4", "x", "RETRY"), ("5", "x" * 1000, "")])
    b = side([("1", "x" * 81, ""), ("2", "x" * 80, ""), ("3", "abc", ""), ("4", "x", ""), ("5", "y" * 1000, "")])
    rows = {r.uri: r for r in compare.compare_text_length(a, b).collect()}
    assert (rows["1"].length_diff_ratio, rows["1"].length_ok) == (0.19, True)
    assert (rows["2"].length_diff_ratio, rows["2"].length_ok) == (0.2, False)
    assert rows["3"].length_diff_ratio is None and rows["3"].length_ok is None and "4" not in rows
    assert len(rows["5"].a_preview) == 500


def test_compare_events(table):
    def run(n, bad=0):
        days = ["2026-02-30"] * bad + ["2026-03-01"] * (n - bad)
        return json.dumps({"events": [{"event_date": d} for d in days]})
    a = table([("1", run(4)), ("2", run(5, 1)), ("3", run(0)), ("4", run(1))], RUN)
    b = table([("1", run(2)), ("2", run(1)), ("3", run(1)), ("4", run(1, 1))], RUN)
    rows = [(r.document_id, r.count_diff, r.count_ok, r.a_valid_dates, r.all_dates_valid) for r in compare.compare_events(a, b).collect()]
    assert rows == [("2", 4, False, 4, True), ("1", 2, True, 4, True), ("4", 0, True, 1, False)]


def test_checks(table):
    df = table([(1, "a", None), (1, "b", "x"), (None, "z", "y"), (3, None, "q")], "k int, v string, w string")
    parent = table([("a",), ("b",)], "p string")
    assert [tuple(r) for r in quality.duplicate_keys(df, ["k"]).collect()] == [(1, 2)]
    assert quality.null_rows(df, "w").count() == 1 and quality.null_rows(df, "w", "k = 3").count() == 0
    assert [tuple(r) for r in quality.orphan_keys(df, "v", parent, "p").collect()] == [("z", 1)]
    checks = quality.table_checks("t", df, ["k"], ["v"], {"w": "k = 3"}, [("v", parent, "p")])
    results = {r.check_name: (r.failures, r.status) for r in quality.run_checks(checks).collect()}
    assert results == {
        "t.k.unique": (1, "fail"), "t.v.not_null": (1, "fail"), "t.w.not_null_where": (0, "pass"), "t.v.relationship": (1, "fail")
    }
    assert tuple(quality.summarise_checks(quality.run_checks(checks)).first()) == (1, 3, 4)
    other = table([(1, "a", None), (1, "b", "x"), (1, "b", "x"), (3, None, "q")], "k int, v string, w string")
    found = quality.row_differences(df, other, ["k", "v", "w"]).collect()
    assert sorted((r.side, r.v, r.n_rows) for r in found) == [("missing", "z", 1), ("unexpected", "b", 1)]
