"""Token counts against whole texts in the library."""

import random

import pyarrow as pa
import pytest

from paperloom.llm import counts

P = pytest.importorskip("public_tokenizers")
PARTS = list("ab1é'sS.,\n\t \r   　！中。") + ["'s", " '", "<|endoftext|>", "don't", "\x0b", "\x1c", "\u0085", " ", "  ", "語。", "(a)", "l'été"]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_pieces_add_up_to_whole_texts(whole):
    rng = random.Random(3)
    cuts = 0
    for _ in range(1500):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 40)))
        found = list(counts.pieces(text, rng.randint(1, 6)))
        assert "".join(found) == text
        assert sum(map(whole, found)) == whole(text), repr(text)
        cuts += len(found) - 1
    assert cuts > 3000


@pytest.mark.parametrize("held", [counts.HELD, 20])
def test_words_add_up_to_whole_texts(whole, monkeypatch, held):
    monkeypatch.setattr(counts, "HELD", held)
    rng = random.Random(5)
    counter = counts.Counter(P.path("byte_bpe_50k.json"), 9, 100)
    for _ in range(60):
        texts = ["".join(rng.choices([*PARTS, " ", " a"], k=rng.randint(0, 30))) for _ in range(rng.randint(0, 25))]
        parts, owners = counts.words(pa.array(texts, pa.string()))
        assert ["".join(p.as_py() for p, o in zip(parts, owners) if o == k) for k in range(len(texts))] == texts
        assert counter.counts(pa.array(texts, pa.string())).tolist() == list(map(whole, texts))


def test_a_stretch_without_a_boundary_stays_whole():
    assert list(counts.pieces("a" * 100 + " b", 10)) == ["a" * 100, " b"]
    assert list(counts.pieces("<|endoftext|>" * 9, 3)) == ["<|endoftext|>" * 9]
    assert list(counts.pieces("", 3)) == [""]


def test_which_files_split():
    assert counts.splits_safely(P.path("byte_bpe_50k.json"))
    assert not counts.splits_safely(P.path("word_bpe_49k.json"))


def test_every_document(spark, whole):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for piece, batch in ((counts.PIECE, counts.BATCH), (50, 300)):
        got = counts.token_counts(rows, P.path("byte_bpe_50k.json"), piece=piece, batch=batch).collect()
        texts = {r.doc_id: r.text or "" for r in rows.collect()}
        assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == {k: (len(t.encode()), whole(t)) for k, t in texts.items()}


def test_other_files(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    texts = ["", "Plain  text, twice.", "<s> a </s>", "été 中文 " * 30]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    words = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for name, count in (("piece_bpe_32k.model", lambda t: len(model.encode(t))), ("word_bpe_49k.json", lambda t: len(words.encode(t, add_special_tokens=False).ids))):
        got = counts.token_counts(rows, P.path(name), piece=8).collect()
        assert {r.doc_id: r.n_tokens for r in got} == {k: count(t) for k, t in enumerate(texts)}


def test_odd_rows(spark, odd_docs, no_docs, whole, tmp_path):
    assert counts.token_counts(no_docs, P.path("byte_bpe_50k.json")).collect() == []
    renamed = odd_docs.withColumn("n_tokens", odd_docs.size).withColumn("n_bytes", odd_docs.text)
    got = counts.token_counts(renamed, P.path("byte_bpe_50k.json"))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    want = [(r.doc_id, len((r.text or "").encode()), whole(r.text)) for r in odd_docs.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = counts.op13(spark, str(tmp_path)).collect()
    assert [r.doc_id for r in rows if r.over_limit] == [4]
