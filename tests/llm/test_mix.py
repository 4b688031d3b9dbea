"""Budgets of a mix against a plain calculation."""

import hashlib

import pytest

from paperloom.llm import mix


def filled(sizes, weights=(5, 2, 1), limit=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(limit * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > limit * sizes[s]}
        if not over:
            return {s: share.get(s, limit * sizes[s]) for s in names}
        capped |= over


def documents():
    rows = []
    for k in range(400):
        source = [None, "b", "a", "Z", "é", "tiny"][min(k * 31 % 23, 5) if k % 40 else 5]
        rows.append((k, " ".join(["w"] * (k * 17 % 60)), source))
    return rows + [(7, "w w w", "a"), (7, "w w w", "a"), (None, None, "a"), (None, "x", None)]


def test_targets_and_taken(spark):
    rows = documents()
    got = mix.budgets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = filled(sizes)
    assert len(got) == len(rows)
    for source, target in want.items():
        own = [r for r in got if r.source == source]
        assert own[0].target == pytest.approx(target)
        assert sum(r.taken for r in own) == int(own[0].target)
        assert all(0 <= r.taken <= 3 * r["size"] for r in own)
        rounds = int(own[0].target) // sizes[source] if sizes[source] else 0
        # Whole rounds first; what is left goes to the first keys.
        order = sorted(own, key=lambda r: hashlib.md5(f"{'null' if r.doc_id is None else r.doc_id}:{mix.SEED}".encode()).hexdigest())
        extra = [r.taken - rounds * r["size"] for r in order if r["size"]]
        first = next((k for k, (e, r) in enumerate(zip(extra, [r for r in order if r["size"]])) if e < r["size"]), len(extra))
        assert all(e == 0 for e in extra[first + 1 :]) or len({r.key for r in order}) < len(order)


def test_reruns_agree(spark):
    df = spark.createDataFrame(documents(), "doc_id long, text string, source string")
    runs = [sorted(map(str, mix.budgets(d).collect())) for d in (df, df.repartition(7))]
    assert runs[0] == runs[1]


def test_copies(spark, odd_docs, no_docs):
    assert mix.copies(no_docs).collect() == [] and mix.budgets(no_docs).collect() == []
    rows = [(k, " ".join(["w"] * (1 + k % 9)), ["a", "b", "c"][k % 3], 1) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    budget = {r.source: r.target for r in mix.budgets(df).collect()}
    got = mix.copies(df)
    assert got.columns == df.columns
    for source, target in budget.items():
        assert abs(sum(len(r.text.split()) for r in got.where(f"source = '{source}'").collect()) - target) <= 9
    assert mix.copies(odd_docs).columns == odd_docs.columns
    assert mix.copies(odd_docs).count() > 0
