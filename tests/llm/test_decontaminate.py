"""Alignment against a plain matrix, planted copies, odd rows."""

import random

import numpy as np
import pyarrow as pa

from paperloom.llm import decontaminate as d


def plain(passage, item):
    h = np.zeros((len(item) + 1, len(passage) + 1), int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if item[i - 1] == passage[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = rng.integers(1, 6)
        sizes, widths = rng.integers(3, 12, n), rng.integers(3, 30, n)
        passages, items = np.full((n, widths.max()), -1), np.full((n, sizes.max()), -3)
        for r in range(n):
            passages[r, : widths[r]] = rng.integers(0, 4, widths[r])
            items[r, : sizes[r]] = rng.integers(0, 4, sizes[r])
        got, first, last = d.align(passages, items, sizes)
        for r in range(n):
            assert got[r] == plain(passages[r, : widths[r]], items[r, : sizes[r]])
            if got[r]:
                assert got[r] == plain(passages[r, first[r] : last[r] + 1], items[r, : sizes[r]])


def corpus(spark, rng):
    words = [f"w{k}" for k in range(3000)]
    text = lambda n: rng.choices(words, weights=[1 / (k + 1) for k in range(3000)], k=n)
    items = {k: text(rng.randint(15, 60)) for k in range(30)}
    docs, planted = {}, set()
    for k in range(400):
        own = text(rng.randint(20, 400))
        if k % 4 == 0:
            item = rng.randrange(30)
            copy = [w.upper() + "," if rng.random() < 0.2 else w for w in items[item]]
            for _ in range(len(copy) // 10):  # edited: words changed, dropped and put in
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([["other"], [], [copy[at], "new"]])
            at = rng.randrange(len(own))
            own[at:at] = copy
            planted.add((k, item))
        docs[k] = " ".join(own)
    docs = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    return docs, spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string"), planted


def test_planted_copies(spark):
    docs, items, planted = corpus(spark, random.Random(7))
    found = d.with_matches(docs, items).selectExpr("doc_id", "explode(matches) AS m").select("doc_id", "m.item_id").collect()
    assert {tuple(r) for r in found} == planted
    clean = {r.doc_id for r in d.without_matches(docs, items).collect()}
    assert clean == set(range(400)) - {k for k, _ in planted}


def test_every_pair_aligned_whole(spark):
    """Seeds lose no pair that aligning every text with every item finds."""
    docs, items, _ = corpus(spark, random.Random(9))
    texts = {r.doc_id: d.item_words(pa.array([r.text]))[0].to_pylist() for r in docs.limit(120).collect()}
    wanted = {r.item_id: d.item_words(pa.array([r.text]))[0].to_pylist() for r in items.collect()}
    code = {w: k for k, w in enumerate(sorted({w for v in [*texts.values(), *wanted.values()] for w in v}))}
    found = set()
    for k, words in texts.items():
        sizes = np.array([len(v) for v in wanted.values()])
        passages = np.tile([code[w] for w in words], (len(wanted), 1))
        rows = np.full((len(wanted), sizes.max()), -3)
        for r, v in enumerate(wanted.values()):
            rows[r, : len(v)] = [code[w] for w in v]
        score, _, _ = d.align(passages, rows, sizes)
        found |= {(k, item) for item, ok in zip(wanted, score >= d.THRESHOLD * 2 * sizes) if ok}
    got = d.with_matches(docs.where(docs.doc_id.isin(list(texts))), items).selectExpr("doc_id", "explode(matches) AS m").select("doc_id", "m.item_id").collect()
    assert {tuple(r) for r in got} == found and len(found) >= 20


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items, planted = corpus(spark, random.Random(8))
    monkeypatch.setattr(d, "BLOCK_WORDS", 300)
    found = d.with_matches(docs, items, keep_text=False).selectExpr("doc_id", "explode(matches) AS m").select("doc_id", "m.item_id").collect()
    assert {tuple(r) for r in found} == planted


def test_a_common_passage_is_found_everywhere(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    docs = spark.createDataFrame([(k, f"a{k} b{k} {passage} c{k}") for k in range(50)], "doc_id long, text string")
    items = spark.createDataFrame([(1, passage), (1, passage), (None, None), (2, ""), (3, "p1 p2")], "item_id long, text string")
    rows = d.with_matches(docs, items).collect()
    assert all([m.item_id for m in r.matches] == [1, 1] for r in rows)


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "w3 thing3 w4 thing4 w5 thing5")], "item_id long, text string")
    assert d.without_matches(no_docs, items).collect() == []
    got = d.without_matches(odd_docs, items)
    assert got.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 0, 1, 4, 5, 6]
    assert d.without_matches(odd_docs, items.limit(0)).count() == odd_docs.count()
