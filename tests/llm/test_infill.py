"""Cuts and parts against lists of lines."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import infill
from paperloom.llm import texts as T


def plain(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 100, 1000])
def test_tree(n):
    rng = np.random.default_rng(n)
    numbers, other = rng.integers(0, 4, n), rng.integers(0, 9, n)
    tree, beside = infill.Fenwick(numbers), infill.Fenwick(other)
    run, run_other = np.concatenate([[0], np.cumsum(numbers)]), np.concatenate([[0], np.cumsum(other)])
    assert (tree.sums(np.arange(n + 1)) == run).all()
    wanted = np.arange(1, run[-1] + 2)
    at, own, others = tree.descend(wanted, beside)
    want = np.searchsorted(run, wanted) - 1
    assert (at == want).all() and (own == run[want]).all() and (others == run_other[want]).all()


@pytest.mark.parametrize("size", [1, 2, 5, 64])
def test_cuts_at_every_unit(size):
    rng = random.Random(size)
    texts = ["".join(rng.choices("ab\n\né中😀", k=rng.randint(0, 60))) for _ in range(80)] + ["", "\n", "x", "", "\n\n\n"]
    data, bounds = T.raw(pa.array(texts))
    blocks = infill.Blocks(data, bounds, size)
    lists = [re.findall(r"[^\n]*\n|[^\n]+", t) for t in texts]
    assert blocks.units.tolist() == list(map(len, lists))
    for k in range(max(map(len, lists)) + 1):
        units = np.minimum(k, blocks.units)
        at, points = blocks.cuts(units)
        heads = ["".join(u[:j]) for u, j in zip(lists, units.tolist())]
        assert (at - bounds[:-1]).tolist() == [len(h.encode()) for h in heads]
        assert points.tolist() == list(map(len, heads))


def test_no_texts():
    data, bounds = T.raw(pa.array([], pa.string()))
    at, points = infill.Blocks(data, bounds).cuts(np.zeros(0, np.int64))
    assert len(at) == len(points) == 0


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 100), (0, 50)])
def test_rows_and_back(spark, odd_docs, rate, spm):
    rng = random.Random(9)
    parts = ["a", "b\n", "\n", "é中", "😀\n", "<", "<P", "S>", ">", "M>"] + ["<P>", "<M>"] * (rate == 40)
    rows = [(k, "".join(rng.choices(parts, k=rng.randint(0, 50)))) for k in range(300)]
    rows += [(3, "same\nrow"), (3, "same\nrow"), (-5, "minus\n"), (400, ("line é\n" * 60_000) + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    got = infill.fill_in_middle(docs, rate=rate, spm=spm)
    want = [plain(r.doc_id, r.text, rate, spm) for r in docs.collect()]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    back = got.select("doc_id", infill.restored().alias("text")).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((r.doc_id or -1, r.text or "") for r in docs.collect())


def test_odd_rows(spark, odd_docs, no_docs):
    assert infill.fill_in_middle(no_docs).collect() == []
    clashing = odd_docs.withColumn("output", odd_docs.text).withColumn("n", odd_docs.size).withColumn("form", odd_docs.lang)
    got = infill.fill_in_middle(clashing)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and got.count() == odd_docs.count()
