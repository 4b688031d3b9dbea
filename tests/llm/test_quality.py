"""Base counts against plain Python, the model's sums, and what the bands do."""

import collections
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    repeated = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeated),
    }


def test_base_counts():
    rng = random.Random(4)
    parts = ["a", "é", " ", "\n", "\t", "\x0b", "\x1c", " ", "#", "|", "ab ", "x y z x y z ", "中"]
    texts = ["", " ", "\n\n", "a"] + ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(400)]
    got, _ = quality.base_counts(pa.array(texts))
    for k, text in enumerate(texts):
        assert {name: int(v[k]) for name, v in got.items()} == counted(text), repr(text)


def prose(rng, n):
    return " ".join("".join(rng.choices(["the", "an", "er", "ing", "re", "st"], k=rng.randint(1, 3))) for _ in range(n))


def test_probabilities_add_up(spark):
    rng = random.Random(0)
    docs = spark.createDataFrame([(k, prose(rng, 200), ["en", None][k % 2]) for k in range(20)], "doc_id long, text string, lang string")
    model = quality.kneser_ney(quality.gram_counts(docs))
    arrays = quality.hash_arrays(model)
    assert (np.diff(arrays[0]) > 0).all()
    points = [ord(c) for c in "theanrigs "]
    for context in ("the", "  t", "zzz", "   "):
        base = 0
        for c in context:
            base = base << 16 | ord(c)
        keys = np.array([base << 16 | p for p in points], np.uint64)
        known = np.exp(quality.log_probability(keys, "en", arrays)).sum()
        unseen = np.array([base << 16 | 0x4E00 + k for k in range(99)], np.uint64)
        rest = np.exp(quality.log_probability(unseen, "en", arrays))[0]
        assert known + rest * (65536 - len(points)) == pytest.approx(1, abs=1e-4)


def test_counts_of_sequences(spark):
    docs = spark.createDataFrame([(1, "ab ab", "en"), (2, "ab", "en"), (3, None, None)], "doc_id long, text string, lang string")
    got = {(r.lang, r.gram): r.n for r in quality.gram_counts(docs).collect()}
    key = lambda s: sum(ord(c) << 16 * (3 - k) for k, c in enumerate(s))
    assert got == {("en", key("   a")): 3, ("en", key("  ab")): 3, ("en", key(" ab ")): 3}


def plain_model(docs):
    """A modified Kneser-Ney model of one language in plain Python: log probability of a character
    after three others."""
    levels = {4: collections.Counter()}
    for text in docs:
        for w in WORD.findall(text):
            padded = "   " + w + " "
            for k in range(len(w) + 1):
                gram = padded[k : k + 4]
                levels[4][re.sub(r"^.* (?=.)", lambda m: " " * len(m[0]), gram[:3]) + gram[3]] += 1
    for k in (3, 2, 1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    p, gammas = {}, {}
    for k in (1, 2, 3, 4):
        t = [sum(n == j for n in levels[k].values()) for j in range(5)]
        y = t[1] / max(t[1] + 2 * t[2], 1)
        d = [0.0] + [j - (j + 1) * y * t[j + 1] / max(t[j], 1) if j < 4 else 0 for j in (1, 2, 3)]
        d = [x if j == 0 or 0 < x < j else j / 2 for j, x in enumerate(d)]
        total, cut = collections.Counter(), collections.Counter()
        for g, n in levels[k].items():
            total[g[:-1]] += n
            cut[g[:-1]] += d[min(n, 3)]
        gammas[k] = {c: cut[c] / total[c] for c in total}
        for g, n in levels[k].items():
            less = p[g[1:]] if k > 1 else 1 / 65536
            p[g] = (n - d[min(n, 3)]) / total[g[:-1]] + gammas[k][g[:-1]] * less

    def score(gram):
        paid = 0.0
        for k in (4, 3, 2, 1):
            g = gram[4 - k :]
            if g in p:
                return paid + math.log(p[g])
            paid += math.log(gammas[k].get(g[:-1], 1.0))
        return paid - 16 * math.log(2)

    return score


def test_against_a_plain_model(spark):
    rng = random.Random(3)
    texts = [prose(rng, 60) for _ in range(12)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)] + [(99, "other words", "de")], "doc_id long, text string, lang string")
    arrays = quality.hash_arrays(quality.kneser_ney(quality.gram_counts(docs)))
    score = plain_model(texts)
    for word in ["the", "aner", "qqq", "string", "x"]:
        keys, _ = quality.sequences(pa.array([word]))
        padded = "   " + word + " "
        want = [score(padded[k : k + 4]) for k in range(len(word) + 1)]
        assert quality.log_probability(keys, "en", arrays).tolist() == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("entries", [quality.ENTRIES, 50])
def test_verdicts(spark, monkeypatch, entries):
    monkeypatch.setattr(quality, "ENTRIES", entries)
    rng = random.Random(1)
    rows = [(k, prose(rng, rng.choice([12, 30, 80, 300])), ["en", "de", None][k % 3]) for k in range(240)]
    rows += [(k + 500, rows[0][1], "en") for k in range(300)]  # copies do not narrow the band
    junk = "".join(chr(rng.randint(0x4E00, 0x9FFF)) + " " * (k % 4 == 0) for k in range(4000))
    rows += [(100 + 1000, junk, "en"), (101 + 1000, "too short", "en"), (102 + 1000, "a b c d e " * 9, "en")]
    rows += [(1200, " ".join(w + "%$&#"[k % 4] * 3 for k, w in enumerate(prose(rng, 14).split())), "en")]
    rows += [(1201, " ".join("".join(rng.choices("qxzjkv0123456789", k=9)) for _ in range(12)), "de")]
    got = {r.carried: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id")).collect()}
    assert len(got) == len(rows) and all(got[k].kept for k in range(240)) and all(got[500 + k].kept for k in range(300))
    for k in (1100, 1200, 1201):
        assert not got[k].kept and not got[k].base_failed and got[k].nats_per_word > got[k].upper
    assert got[1101].base_failed and got[1102].base_failed and not got[1102].kept


def test_labelled_documents(spark):
    """Of the labelled texts that pass the base rules, bands reject bad ones and hardly any good one."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    judged = quality.judge(docs, F.col("doc_id")).withColumnRenamed("carried", "doc_id").where("NOT base_failed").join(labels, "doc_id")
    found = {r.quality: r for r in judged.groupBy("quality").agg(F.count("*").alias("n"), F.count_if(~F.col("kept")).alias("gone")).collect()}
    assert found[0].gone >= 0.4 * found[0].n and found[1].gone <= 0.005 * found[1].n


def test_odd_rows(odd_docs, no_docs):
    assert quality.judge(no_docs, F.col("doc_id")).collect() == [] and quality.keep_good(no_docs).collect() == []
    got = quality.judge(odd_docs, F.col("doc_id")).collect()
    assert len(got) == odd_docs.count()
    assert {r.carried for r in got if r.kept} == {2, 3}
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 3


@pytest.mark.parametrize("held", [quality.HELD, 3000])
def test_a_task_holds_the_sequences_of_few_texts(monkeypatch, held):
    """One batch of 6 MB of new words: sequences are merged as they are met, and none is lost."""
    monkeypatch.setattr(quality, "HELD", held)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(1000)) for _ in range(600)]
    langs = ["en", None] * 300
    batch = pa.RecordBatch.from_arrays([pa.array(langs), pa.array(texts)], ["lang", "text"])
    tracemalloc.start()
    try:
        rows = pa.Table.from_batches(quality._counted(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 150e6, peak
    got = collections.Counter()
    for lang, gram, n in zip(*(rows.column(c).to_pylist() for c in ("lang", "gram", "n")), strict=True):
        got[lang, gram] += n
    want = collections.Counter()
    for lang in ("en", None):
        words = [w for text, x in zip(texts, langs, strict=True) if x == lang for w in text.split(" ")]
        keys, n = np.unique(quality.sequences(pa.array(words))[0].view(np.int64), return_counts=True)
        want.update({(lang, k): c for k, c in zip(keys.tolist(), n.tolist(), strict=True)})
    assert got == want
