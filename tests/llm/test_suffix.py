"""Repeated strings against a count of every window; the suffix array against sorting."""

import collections
import hashlib
import random

import numpy as np
import pytest

from paperloom.llm import suffix
from paperloom.llm.lyndon import suffix_array


def removed(docs):
    texts = [(i, (t or "").encode()) for i, t in docs]
    seen = collections.Counter(b[k : k + 200] for _, b in texts for k in range(len(b) - 199))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def planted():
    rng = random.Random(3)

    def word():
        return "".join(rng.choices("abcdeé", k=rng.randint(1, 6)))

    base = [" ".join(word() for _ in range(rng.randint(5, 200))) for _ in range(12)]
    docs = [(None, None), (0, ""), (1, "a" * 1000), (2, "ab" * 300), (3, "x" * 199), (4, "y" * 200), (5, "y" * 200), (6, "é" * 100), (7, "é" * 101)]
    for i in range(60):
        text = ""
        for _ in range(rng.randint(1, 4)):
            b = rng.choice(base)
            a = rng.randint(0, len(b))
            text += b[a : rng.randint(a, len(b))] + word() * rng.randint(0, 30)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(text) + 1)
            text = text[:k] + "Z" + text[k + 1 :]
        docs.append((100 + i, text))
    return docs + docs[20:24]


@pytest.mark.parametrize("hot", [suffix.HOT, 1])
def test_against_every_window(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    docs = planted()
    got = suffix.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    key = str
    assert sorted(((*r[:5], bytes(r.kept)) for r in got), key=key) == sorted(removed(docs), key=key)


def test_small_batches_keep_anchors_whole(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BATCH", 3)
    docs = planted()[:40]
    got = suffix.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string"), keep_text=False).collect()
    assert sorted(map(tuple, got), key=str) == sorted((r[:5] for r in removed(docs)), key=str)


def test_odd_rows(odd_docs, no_docs):
    assert suffix.drop_repeats(no_docs).collect() == []
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix.drop_repeats(odd_docs).collect()}
    text = odd_docs.where("doc_id = 3").first().text
    assert {(None, 0, 0), (1, 0, 0), (4, 300_000, 300_000), (3, len(text), len(text))} <= got


def test_suffix_array():
    rng = np.random.default_rng(0)
    for k in range(300):
        s = rng.integers(0, rng.integers(1, 5), rng.integers(0, 40)).tolist() * (1 + k % 3)
        assert suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
