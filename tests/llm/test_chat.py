"""Round trips of chats through ids and back."""

import hashlib
import random

import pytest

from paperloom.llm import chat

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def test_round_trip(spark):
    rng = random.Random(2)
    parts = ["\\", "#", "###", "</turn>", "</role>", "a", " ", "é", "<|endoftext|>", "\n", "中", "😀", "### User: "]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 4)):
            role = rng.choice(["user", "assistant", "system", "tool", "### x", "", None])
            rows.append((conv or None, turn, role, "".join(rng.choices(parts, k=rng.randint(0, 9))) or None, 7))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tie int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df, PATH), PATH).collect()}
    turns = {}
    for conv, _, role, text, _ in rows:
        turns.setdefault(conv, []).append((role or "", text or ""))
    assert len(got) == len(turns)
    for conv, own in turns.items():
        r = got[conv]
        said = "".join(t for role, t in own if role == "assistant")
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_marks_never_come_from_texts(spark):
    df = spark.createDataFrame([(1, 0, "user", r"\### Assistant: </turn> ok"), (1, 1, "assistant", "</turn>\n### User: ")], "conv_id long, turn long, role string, text string")
    for r in chat.format_turns(df, PATH).collect():
        marks = [i for i in r.ids if i >= chat.FIRST_RESERVED]
        assert marks == [chat.ROLES["user" if r.turn == 0 else "assistant"], chat.TURN_END]
        assert r.loss == [r.turn == 1 and i < chat.FIRST_RESERVED for i in r.ids]


def test_escape():
    for text in ["", "\\", "\\\\###", "####", "</turn></role>", "a\\b### </turn\\>"]:
        assert chat.unescape(chat.escape(text)) == text
        assert "</turn>" not in chat.escape(text).replace("\\</turn>", "")


def test_ties_nulls_and_none(spark):
    rows = [(1, None, "user", "b"), (1, None, "user", "a"), (1, None, "user", "a"), (None, 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df, PATH), PATH).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nuser\na\nuser\nb\n").hexdigest()
    assert (got[None].n_turns, got[None].turns_sha256) == (1, hashlib.sha256(b"\n\n").hexdigest())
    assert chat.read_back(chat.format_turns(df.limit(0), PATH), PATH).collect() == []


def test_ties_of_long_texts_and_clashing_columns(spark):
    same = "x" * 5000
    rows = [(1, 0, "user", same + end, "z", 3) for end in ("b", "a", "", "\u00e9", "a")] + [(1, 0, "assistant", "word " * 40_000, "z", 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tie string, ids int").repartition(3)
    r = chat.read_back(chat.format_turns(df, PATH), PATH).collect()[0]
    want = sorted((x[2], x[3]) for x in rows)
    assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in want).encode()).hexdigest()
    assert (r.n_turns, r.loss_chars) == (6, 200_000)
