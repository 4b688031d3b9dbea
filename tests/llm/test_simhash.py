"""SimHash components against all pairs of fingerprints."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from paperloom.llm import simhash
from paperloom.llm.components import components


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode())
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_a_task_holds_the_shingles_of_few_texts():
    """One batch of 6 MB of text: a task's memory does not follow the batch."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefgh", k=5000)) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    try:
        got = pa.Table.from_batches(simhash._printed(3)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 80e6, peak
    prints = got.column("fp").to_numpy().view(np.uint64)
    assert got.column("doc_id").to_pylist() == list(range(600)) and prints[:9].tolist() == [fingerprint(t) for t in texts[:9]]


def test_masks_cover_every_choice():
    rng = random.Random(1)
    held = [0, simhash.covering_masks(0)[3], simhash.covering_masks(simhash.covering_masks(0)[3])[5]]
    for h in held:
        masks = simhash.covering_masks(h)
        free = [b for b in range(64) if not h >> b & 1]
        for _ in range(500):
            flipped = sum(1 << b for b in rng.sample(free, min(3, len(free))))
            assert any(m & flipped == 0 and m & h == h for m in masks)


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 4])
def test_links_against_all_pairs(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for base in list(prints)[:6]:
        for _ in range(60):  # a dense group, many times a bucket
            prints.add(base ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 4))))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    assert grouped(signed, [(r.u, r.v) for r in links]) == grouped(signed, near)


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    rows = spark.createDataFrame([*links, (7, None), (None, 7), (300, 300)], "u long, v long")
    got = {r.node: r.root for r in components(rows).collect()}
    nodes = {n for pair in links for n in pair}
    want = grouped(nodes, links)
    assert {n: got.get(n, n) for n in nodes} == want and set(got) <= nodes


def test_documents(spark, odd_docs, no_docs):
    assert simhash.near_groups(no_docs).collect() == [] and simhash.keep_one(no_docs).collect() == []
    rows = odd_docs.select("doc_id", "text").collect()
    got = simhash.near_groups(odd_docs).collect()
    assert sorted((r.doc_id, r.fp & (2**64 - 1)) for r in got if r.doc_id) == sorted((r.doc_id, fingerprint(r.text)) for r in rows if r.doc_id)
    assert {r.doc_id: r.component_id for r in got if r.doc_id} == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6}
    assert [r.component_id for r in got if r.doc_id is None] == [1, 1]  # no words, as doc 1


def test_one_of_each_component_stays(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(2000)]
    docs = []
    for k in range(60):
        own = rng.choices(words, k=rng.randint(100, 500))
        docs.append((10 * k + 5, " ".join(own)))
        for j, edits in enumerate((1, 3, len(own) // 8)):
            other = list(own)
            for _ in range(edits):
                other[rng.randrange(len(other))] = rng.choice(words)
            docs.append((10 * k + j, " ".join(other).upper()))
    docs += [(1000 + k, docs[0][1]) for k in range(100)] + [(None, docs[0][1]), (2000, ""), (2001, " \n"), (2002, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    prints = {k: fingerprint(t) for k, t in docs if k is not None}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    roots = grouped(prints, near)
    kept = [r.doc_id for r in simhash.keep_one(frame).collect()]
    assert sorted(kept) == sorted(set(roots.values())) and 2000 in kept and len(kept) < len(docs) - 150


def test_rows_are_carried(spark, odd_docs):
    got = simhash.keep_one(odd_docs.withColumn("place", odd_docs.size).withColumn("component_id", odd_docs.key))
    assert got.columns == [*odd_docs.columns, "place", "component_id"]
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 4, 5, 6]
