import random

import pytest
from pyspark.sql import functions as F

from paperloom.fixed import WHITESPACE
from paperloom.operators.chunking import chunk_documents, chunk_fixed, split_by_headings

SCHEMA = """document_id string, uri string, content_type string, size bigint, md5_hash string,
    updated_at timestamp, extracted_markdown string"""


def stored(table, texts):
    import datetime as dt

    rows = [
        (f"d{i}", f"gs://s/{i}.pdf", "application/pdf", 100, f"h{i}", dt.datetime(2026, 4, 25), t)
        for i, t in enumerate(texts)
    ]
    return table(rows, SCHEMA)


def chunked(table, texts, **options):
    rows = chunk_documents(stored(table, texts), unique_ids=True, **options).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.document_id, r.chunk_index)):
        out.setdefault(r.document_id, []).append(r.chunk_text)
        assert r.chunk_index == len(out[r.document_id]) - 1
    return [out.get(f"d{i}", []) for i in range(len(texts))]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("イントロのテキストです。\n\n●セクションの詳細内容", ["イントロのテキストです。", "●セクションの詳細内容"]),
        ("冒頭のテキストです。\n\n▶イベント予告の詳細内容", ["冒頭のテキストです。", "▶イベント予告の詳細内容"]),
        (
            "前半のテキスト内容です。\n\n*5月のお知らせ情報*\n\n後半のテキスト内容です。",
            ["前半のテキスト内容です。", "*5月のお知らせ情報*\n\n後半のテキスト内容です。"],
        ),
        ("●最初のセクション内容\n\n●二番目のセクション内容", ["●最初のセクション内容", "●二番目のセクション内容"]),
    ],
)
def test_sections_become_chunks(table, text, expected):
    assert chunked(table, [text]) == [expected]


@pytest.mark.parametrize(
    "text, n",
    [("イントロ\n## セクション", 2), ("イントロ\n●セクション", 2), ("イントロ\n▶イベント", 2),
     ("イントロ\n*見出し*\nコンテンツ", 2), ("イントロ\n●最初\n●次", 3), ("## 最初", 2), ("普通の文", 1)],
)
def test_heading_count(table, text, n):
    rows = table([(text,)], "t string").select(F.size(split_by_headings("t")).alias("n")).collect()
    assert rows[0].n == n


def test_boundaries(table):
    long_sentence = "あ" * 1499
    texts = [
        "123456789",
        "1234567890",
        "あ" * 1500,
        "い" * 700 + "。" + "う" * 799,  # 1500 characters: kept whole with its mark
        "い" * 700 + "。" + "う" * 800,  # 1501: cut, the second sentence crosses the limit
        "前の段落の文章です。\n\n| a | b |\n\n| c | d |\n\n後の段落の文章です。",
        "一行目の文章です\r\n二行目の文章です",
        "　\n\t  ",
        long_sentence + "。" + "え" * 20 + "。",  # running length exactly 1500 opens group 1
        "",
    ]
    got = chunked(table, texts)
    assert got[0] == []
    assert got[1] == ["1234567890"]
    assert got[2] == ["あ" * 1500]
    assert got[3] == [texts[3]]
    assert got[4] == ["い" * 700, "う" * 800]
    assert got[5] == ["前の段落の文章です。", "| a | b |\n| c | d |", "後の段落の文章です。"]
    assert got[6] == ["一行目の文章です\n二行目の文章です"]
    assert got[7] == []
    assert got[8] == [long_sentence + "。" + "え" * 20]
    assert got[9] == []


def test_table_is_never_cut(table):
    text = "\n\n".join("| " + "セル。" * 100 + "|" for _ in range(10))
    assert len(chunked(table, [text])[0]) == 1


def by_hand(text, limit=1500, min_chars=10):
    """The chunk rule spelled out in plain Python."""
    import re

    text = "\n" + text.replace("\r\n", "\n")
    marked = re.sub(r"\n(#{1,3} |[●▶]|\*[^\n*]{1,20}\*)", "\n\x01\n\\1", text)
    out = []
    for section in marked.split("\x01"):
        paragraphs = [p.strip(WHITESPACE) for p in section.strip(WHITESPACE).split("\n\n")]
        blocks = []
        for p in [p for p in paragraphs if p]:
            kind = p.startswith("|")
            if blocks and blocks[-1][0] == kind:
                blocks[-1][1].append(p)
            else:
                blocks.append((kind, [p]))
        for kind, ps in blocks:
            block = ("\n" if kind else "\n\n").join(ps)
            if kind or len(block) <= limit:
                out.append(block)
                continue
            running, groups = 0, {}
            for s in [s.strip(WHITESPACE) for s in block.split("。")]:
                if s:
                    running += len(s) + 1
                    groups.setdefault(running // limit, []).append(s)
            out += ["。".join(g) for _, g in sorted(groups.items())]
    return [c for c in out if len(c.strip(WHITESPACE)) >= min_chars]


def random_text(rng):
    parts = []
    for _ in range(rng.randint(1, 60)):
        kind = rng.random()
        words = "".join(rng.choice("あいうえお漢字abc 　。") for _ in range(rng.randint(0, 160)))
        head = "## " if kind < 0.1 else "●" if kind < 0.2 else "| " if kind < 0.4 else "*題*" if kind < 0.45 else ""
        parts.append(head + words)
        parts.append(rng.choice(["\n", "\n\n", "\n\n", "\r\n", "\n\n\n"]))
    return "".join(parts)


def test_fused_chunker_equals_plain_rule(table):
    rng = random.Random(5)
    texts = [random_text(rng) for _ in range(60)] + ["あ。" * 4000, "い" * 1499 + "。" + "う" * 4000 + "。え"]
    assert chunked(table, texts) == [by_hand(t) for t in texts]


def test_numbering_by_place_equals_numbering_in_the_row(table):
    rng = random.Random(9)
    df = stored(table, [random_text(rng) for _ in range(25)])
    columns = ["document_id", "chunk_index", "chunk_text", "chunk_id"]
    fused = chunk_documents(df, unique_ids=True).select(*columns)
    # Without the promise of unique ids the numbers are the same.
    assert sorted(chunk_documents(df).select(*columns).collect()) == sorted(fused.collect())


def test_shared_and_missing_ids_are_numbered_together(table):
    rows = [("x", f"u{i}", f"first part number {i}\n●second part number {i}") for i in range(40)]
    rows += [(None, f"n{i}", f"a text without an id {i}") for i in range(5)]
    df = table(rows, "document_id string, uri string, extracted_markdown string")
    got = chunk_documents(df).collect()
    shared = sorted((r.chunk_index, r.chunk_text) for r in got if r.document_id == "x")
    assert [i for i, _ in shared] == list(range(80))
    assert all(t.startswith("first") for _, t in shared[:40]) and all(t.startswith("●") for _, t in shared[40:])
    missing = [r for r in got if r.document_id is None]
    assert sorted(r.chunk_index for r in missing) == list(range(5))
    assert all(r.chunk_id is None for r in missing)


def test_chunk_id_separator_avoids_collisions(table):
    text = "\n".join(f"●section number {i}" for i in range(12))
    df = table([("1", "a", text), ("11", "b", text)], "document_id string, uri string, extracted_markdown string")
    plain = chunk_documents(df, unique_ids=True)
    kept = chunk_documents(df, unique_ids=True, id_separator=":")
    assert plain.select("chunk_id").distinct().count() < plain.count()  # "1"+"11" and "11"+"1"
    assert kept.select("chunk_id").distinct().count() == kept.count()


def test_fixed_windows(table):
    df = table([("a", "abc。defgh。ij"), ("b", ""), ("c", "x" * 8), ("d", None)], "id string, t string")
    carried = {}
    for r in sorted(chunk_fixed(df, "t", size=4).collect(), key=lambda r: r.chunk_index):
        carried.setdefault(r.id, []).append(r.chunk_text)
    assert carried["a"] == ["abc。", "defg", "h。ij"] and "".join(carried["a"]) == "abc。defgh。ij"
    assert carried["c"] == ["xxxx", "xxxx"] and carried["b"] == [""] and "d" not in carried
    alone = [r.chunk_text for r in sorted(chunk_fixed(df, "t", size=7, carry=False).where("id = 'a'").collect())]
    assert alone == ["abc。", "gh。ij"]
