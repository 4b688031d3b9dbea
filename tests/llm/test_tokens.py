"""Pieces against whole texts, the coder's round trips, files against the library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import rangecoder, tokens

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_pieces_give_the_ids_of_whole_texts(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "HELD", 60)
    encoder, rng = tokens.PieceEncoder(PATH), random.Random(1)
    parts = list("ab1é'sS.,\n\t \r   　！中") + ["'s", " '", "<|endoftext|>", "don't", "\x0b", "\x1c", "\u0085", " "]
    for _ in range(100):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(rng.randint(0, 40))]
        ids, at = encoder.encode(pa.array(texts, pa.string()))
        for k, text in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_tokens_across_a_space(tokenizer):
    encoder = tokens.PieceEncoder(PATH)
    texts = ["a" + " \u00a0" * n + end for n in range(1, 19) for end in ("", " ", " b", "b", "\u00a0")] + ["plain text", "\u00a0 \u00a0 x", "\t \t \n \n a"]
    for token in tokenizer.get_vocab():
        raw = tokens._token_bytes(token)
        if b" " in raw[1:]:
            texts += [start + raw.decode() + end for start in ("", "a", " ") for end in ("", "b", " b")]
    ids, at = encoder.encode(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


class Counting:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.n = tokenizer, 0

    def encode_batch_fast(self, texts, **more):
        self.n += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **more)


def test_known_pieces_are_not_encoded_again():
    encoder = tokens.PieceEncoder(PATH)
    encoder.tokenizer = library = Counting(encoder.tokenizer)
    texts = pa.array([" ".join(f"w{k}" for k in range(a, a + 1000)) for a in range(0, 100_000, 1000)])
    first = encoder.encode(texts)[0]
    seen, library.n = library.n, 0
    assert (encoder.encode(texts)[0] == first).all()
    assert seen < 2_000_000 and library.n == 0


def test_pieces_that_do_not_part_at_their_edges_are_encoded_alone(tokenizer):
    encoder = tokens.PieceEncoder(PATH)
    pieces = [f" {p}" for p in ("a", "bé", "\n", "\t", "\u00a0", "\u00a0\u00a0", "'s", "\u4e2d")]
    want = [i for p in pieces for i in tokenizer.encode(p, add_special_tokens=False).ids]
    for broken in (False, True):  # no widths: every piece alone
        encoder.width *= not broken
        ids, sizes = encoder._joined(pa.array(pieces * 40))
        assert ids.tolist() == want * 40 and len(sizes) == len(pieces) * 40
        assert [i for i in np.split(ids, np.cumsum(sizes))[6].tolist()] == tokenizer.encode(" 's", add_special_tokens=False).ids


def test_words_are_cut_where_the_library_parts_them(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "HELD", 500)
    monkeypatch.setattr(tokens, "PAIRS", 7)
    encoder, rng = tokens.PieceEncoder(PATH), random.Random(4)
    parts = list("abls19.,;!?#$%&*(<_'-\"\n\n\n\t\r\x00\x1c\x7f   éßàÅ×÷\u00a0\u0085\u2028\u3000«中") + ["'ll", "'re", "'s", ".\n", "\n\n", "the", "!'", "''", " '", "12", "(a)"]
    for _ in range(300):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(40)]
        ids, at = encoder.encode(pa.array(texts, pa.string()))
        for k, text in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_are_encoded_once_whatever_stands_beside_them():
    encoder = tokens.PieceEncoder(PATH)
    encoder.tokenizer = library = Counting(encoder.tokenizer)
    words = [f"word{k}" for k in range(3000)]
    for end in (".", ",", "!", ".\nThe", "###"):
        encoder.encode(pa.array([" ".join(w + end for w in words)]))
    assert library.n < 2 * sum(map(len, words))


def test_a_worker_keeps_the_words_from_task_to_task(monkeypatch):
    made = []
    monkeypatch.setattr(tokens, "PieceEncoder", lambda path, kind=tokens.PieceEncoder: made.append(kind(path)) or made[-1])

    class Shared:
        value = tokens._Worker(PATH)

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a few words", "a few more"]), pa.array([0, 0], pa.int32())], ["doc_id", "text", "part"])
    rows = [list(tokens._segments(Shared, 0)(iter([batch]))) for _ in range(3)]
    assert len(made) == 1 and len(made[0].pieces) and all(r[0].equals(rows[0][0]) for r in rows)


def test_the_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "HELD", 1000)
    encoder = tokens.PieceEncoder(PATH)
    for k in range(40):
        encoder.encode(pa.array([" ".join(["often", *(f"w{k}x{j}" for j in range(300))])]))
        assert len(encoder.pieces) <= 1000
    assert "often" in encoder.pieces.to_pylist()  # what is met often stays
    monkeypatch.setattr(tokens, "HELD_BYTES", 1000)
    encoder.encode(pa.array(["y" * 900 + " " + "z" * 900]))
    encoder.encode(pa.array(["x"]))
    assert encoder.pieces.nbytes < 1000


def test_coder_round_trips():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 511, 513, 3000, 40_000):
        for high in (1, 2, 300, 65536):
            ids = rng.integers(0, high, n)
            ids = np.where(rng.random(n) < 0.6, np.roll(ids, 7), ids)
            table, blocks = rangecoder.encode(ids)
            assert (rangecoder.decode(table, blocks) == ids).all()
    with pytest.raises(ValueError):
        rangecoder.encode(np.array([65536]))


def test_coder_gains_from_context():
    ids = np.tile(np.random.default_rng(2).integers(0, 5000, 100), 300)
    _, blocks = rangecoder.encode(ids)
    assert sum(map(len, blocks)) < len(ids)  # under 8 bits an id, where order 0 needs over 6.6


def test_coder_of_ids_that_are_all_but_sure():
    for ids in (np.zeros(5000, np.int64), np.tile([65535, 0], 3000), np.full(1, 65535)):
        table, blocks = rangecoder.encode(ids)
        assert (rangecoder.decode(table, blocks) == ids).all()


def test_blocks_are_independent_and_checked():
    ids = np.random.default_rng(3).integers(0, 300, 5000)
    table, blocks = rangecoder.encode(ids)
    assert len(blocks) > 2
    steps = -(-5000 // len(blocks))
    for k, block in enumerate(blocks):
        assert (rangecoder.decode(table, [block]) == ids[k * steps : (k + 1) * steps]).all()
    bad = bytearray(blocks[1])
    bad[14] ^= 1
    with pytest.raises(ValueError, match="block 1"):
        rangecoder.decode(table, [blocks[0], bytes(bad), *blocks[2:]])


def checked(spark, folder, docs, tokenizer):
    start = 0
    want = []
    for i, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    digest = tokens.read_tokens(spark, folder, digest=True).collect()
    assert sorted(map(tuple, digest), key=lambda r: r[1]) == [w[:4] for w in want]
    whole = tokens.read_tokens(spark, folder).collect()
    assert sorted(((r.doc_id, r.start, r.ids) for r in whole), key=lambda r: r[1]) == [(w[0], w[1], w[4]) for w in want]


def test_files(spark, tmp_path, monkeypatch, tokenizer):
    monkeypatch.setattr(tokens, "SEGMENT", 3000)
    rng = random.Random(6)
    docs = [(k, " ".join(rng.choices(["the", "of", "ering!", "Zü", "!"], k=rng.randint(0, 300)))) for k in range(-20, 120)]
    docs += [(500, "x" * 40_000), (501, None), (502, "")]
    rng.shuffle(shuffled := list(docs))
    df = spark.createDataFrame([(t, i, "r") for i, t in shuffled], "text string, doc_id long, row string").repartition(5)
    tokens.write_tokens(df, f"{tmp_path}/t", PATH)
    checked(spark, f"{tmp_path}/t", docs, tokenizer)


def test_odd_rows(spark, tmp_path, odd_docs, no_docs, tokenizer):
    tokens.write_tokens(no_docs, f"{tmp_path}/none", PATH)
    assert tokens.read_tokens(spark, f"{tmp_path}/none").collect() == []
    tokens.write_tokens(odd_docs, f"{tmp_path}/odd", PATH)
    rows = sorted(odd_docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    checked(spark, f"{tmp_path}/odd", [(r.doc_id, r.text) for r in rows], tokenizer)
