"""Line chunks against a plain version, and against all repeated runs of lines."""

import hashlib
import random
from collections import Counter

from paperloom.llm import lines

SPACE = " \t\n\v\f\r"


def chunks(own):
    """(first, last, line with a word before, line with a word after) of every chunk."""
    places = [k for k, line in enumerate(own) if line.strip(SPACE)]
    kinds = [(int(hashlib.md5(own[k].encode()).hexdigest()[:8], 16) >> 4) % lines.CUTS for k in places]
    for cut in range(lines.CUTS):
        of = [j for j, kind in enumerate(kinds) if kind == cut]
        for a, b in zip(of, of[1:], strict=False):
            yield places[a], places[b], places[a - 1] if a else None, places[b + 1] if b + 1 < len(places) else None


def spans(own):
    for first, last, before, after in chunks(own):
        yield first, last
        if before is not None:
            yield before, last
        if after is not None:
            yield first, after


def plain(docs):
    def key(i, t):
        return hashlib.md5(f"{'null' if i is None else i}|{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()

    first, out = {}, []
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, key(*d))):
        own = (t or "").split("\n")
        for a, b in sorted(spans(own)):
            first.setdefault("\n".join(own[a : b + 1]), (key(i, t), a))
    for i, t in docs:
        own = (t or "").split("\n")
        gone = set()
        for a, b in spans(own):
            if first["\n".join(own[a : b + 1])] != (key(i, t), a):
                gone |= set(range(a, b + 1))
        kept = [line for k, line in enumerate(own) if k not in gone]
        out.append((i, None if t is None else "\n".join(kept), len(own), len(gone)))
    return out


def dropped(spark, docs):
    found = lines.drop_repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    return [(r.row.doc_id, r.text, r.n_lines, r.n_removed) for r in found]


def test_against_plain(spark):
    rng = random.Random(9)
    passages = [[f"line {rng.randrange(10**6)}" for _ in range(rng.randint(2, 40))] for _ in range(8)]
    passages += [["a", "", "b", " \t", "c", "d"], ["same"] * 9, ["x", "y"] * 6]
    docs = []
    for k in range(120):
        own = [rng.choice([f"own {k} {j}", ""]) for j in range(rng.randint(0, 6))]
        for _ in range(rng.randint(0, 3)):
            own += rng.choice(passages) + [f"between {k} {rng.random()}"] * rng.randint(0, 2)
        docs.append((k, "\n".join(own)))
    docs += [(7, docs[3][1]), docs[5], (None, None), (None, ""), (200, "\n\n\n \n"), (201, "\n\n\n \n")]
    got = dropped(spark, docs)
    assert sorted(got, key=str) == sorted(plain(docs), key=str)
    assert sum(r[3] for r in got) > 300


def test_short_passages_of_different_texts_go(spark):
    """Every repeated window of three lines with words, listed by brute force, is left once; what is
    not repeated stays, and so does the first of each repeated line."""
    rng = random.Random(4)
    passages = [[f"passage {p} line {k}" for k in range(rng.randint(3, 8))] for p in range(60)]
    docs = []
    for k in range(300):
        own = [f"own {k} first"] * (k % 2)
        for p in rng.sample(passages, 2):
            own += p + [f"own {k} {rng.random()}" for _ in range(rng.randint(1, 4))]
        docs.append((k, "\n".join(own)))

    def surplus(texts):
        windows = Counter(tuple(own[i : i + 3]) for own in (t.split("\n") for t in texts) for i in range(len(own) - 2))
        return sum(n - 1 for n in windows.values())

    got = dropped(spark, docs)
    assert surplus(t for _, t in docs) > 1000 and surplus(r[1] for r in got) == 0
    before = Counter(line for _, t in docs for line in t.split("\n"))
    after = Counter(line for r in got for line in r[1].split("\n"))
    assert all(after[line] == n for line, n in before.items() if line.startswith("own"))
    assert all(after[line] == 1 for line in before if line.startswith("passage"))


def test_one_common_line_stays(spark):
    docs = [(k, f"own {k}\n\nshared\n\nrest {k}") for k in range(50)]
    assert {r[3] for r in dropped(spark, docs)} == {0}


def test_a_shifted_passage_is_cut_alike(spark):
    passage = "\n".join(f"passage line {k}" for k in range(60))
    rows = {r[0]: r for r in dropped(spark, [(1, "a\nb\n" + passage), (2, "one more line\nc\nd\ne\n" + passage + "\nend")])}
    assert rows[1][3] == 0 and rows[2][1] == "one more line\nc\nd\ne\nend"


def test_very_long_texts(spark):
    many = "\n".join(f"line {k}" for k in range(40_000))
    rows = {r[0]: r for r in dropped(spark, [(1, many), (2, "before\n" + many), (3, "same\n" * 40_000)])}
    assert rows[1][3] == 0 and rows[2][1] == "before" and rows[3][1] in ("same\n", "same\nsame\n")


def test_odd_rows(odd_docs, no_docs):
    assert lines.drop_repeated(no_docs).collect() == []
    got = lines.drop_repeated(odd_docs)
    assert got.select("row.*").columns == odd_docs.columns
    rows = got.collect()
    assert len(rows) == odd_docs.count() and all(r.text == r.row.text and r.n_removed == 0 for r in rows)


def test_no_python_in_the_plan(spark, odd_docs):
    plan = lines.drop_repeated(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
