"""Chat formatting on token level, with loss masks.

A turn is the reserved id of its role, the ids of its text and the reserved end id; a role without
an id of its own is spelt out between two reserved ids. Roles and texts are encoded by
themselves, so no id ever joins a mark and a text, and reserved ids lie above the vocabulary. The
printed form of the marks (``### User: ``, ``</turn>`` and so on) may occur in texts: control
strings and backslashes there get a backslash before them, which reading back takes off. The loss
mask is the running sum of +1 after an assistant's mark and -1 at the turn's end.

``format_turns`` gives one row per turn, so a conversation may be of any length; ``read_back``
streams the turns of each conversation in order and holds one batch at a time.

Nulls: a null text or role is empty, a null turn comes first, null conversation ids are one
conversation. Turns alike in number come in the order of the first 64 bytes of role and text
and then of their hash, repeated rows are repeated turns. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import texts as T
from paperloom.llm.store import query, table, written

#: Reserved ids by role; ids from here on are above the vocabulary.
FIRST_RESERVED = 50257
ROLES = {"system": FIRST_RESERVED, "user": FIRST_RESERVED + 1, "assistant": FIRST_RESERVED + 2}
OTHER, ROLE_END, TURN_END = FIRST_RESERVED + 3, FIRST_RESERVED + 4, FIRST_RESERVED + 5
PRINTED = {
    ROLES["system"]: "### System: ",
    ROLES["user"]: "### User: ",
    ROLES["assistant"]: "### Assistant: ",
    OTHER: "### Role ",
    ROLE_END: "</role> ",
    TURN_END: "</turn>\n",
}
_CONTROL = r"\\|###|</role>|</turn>"


def escape(text: str) -> str:
    return re.sub(_CONTROL, r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(rf"\\({_CONTROL})", r"\1", text)


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


def _formatted(path: str):
    def run(batches):
        tokenizer = _tokenizer(path)
        for batch in T.slices(batches, 4 << 20):
            roles, texts = T.column(batch, "role").to_pylist(), T.column(batch, "text").to_pylist()
            own = [r for r in roles if r not in ROLES]
            found = tokenizer.encode_batch_fast([escape(x) for x in texts + own], add_special_tokens=False)
            named = iter([e.ids for e in found[len(texts) :]])
            ids, at, begins, ends = [], [0], [], []
            for role, text in zip(roles, found, strict=False):
                ids += [ROLES[role]] if role in ROLES else [OTHER, *next(named), ROLE_END]
                if role == "assistant":
                    begins.append(len(ids))
                ids += text.ids
                if role == "assistant":
                    ends.append(len(ids))
                ids.append(TURN_END)
                at.append(len(ids))
            step = np.zeros(len(ids) + 1, np.int64)
            np.add.at(step, begins, 1)
            np.add.at(step, ends, -1)
            mask = np.cumsum(step[:-1]) > 0
            at = pa.array(at, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(at, pa.array(mask))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *lists], ["conv_id", "turn", "tie", "ids", "loss"])

    return run


def format_turns(turns: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, turn, tie, ids, loss) of every row of (conv_id, turn, role, text); ``tie``,
    its role and text, orders turns alike in number."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    tie = F.struct(role.alias("role"), text.alias("text")).alias("tie")
    rows = turns.select("conv_id", "turn", tie, role.alias("role"), text.alias("text"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]
    return rows.mapInArrow(_formatted(tokenizer), f"conv_id {kinds[0]}, turn {kinds[1]}, tie struct<role:string,text:string>, ids array<int>, loss array<boolean>")


# --- reading back ------------------------------------------------------------------------


def _turn(ids: np.ndarray, loss: np.ndarray, decode) -> tuple[str, str, str, int]:
    """Role, text, text under the mask, and characters of the printed turn."""
    marks = np.flatnonzero(ids >= FIRST_RESERVED)
    names = {v: k for k, v in ROLES.items()}
    first = int(ids[0])
    printed = sum(len(PRINTED[int(m)]) for m in ids[marks])
    if first == OTHER:
        spelt = decode(ids[1 : marks[1]])
        role, begin = unescape(spelt), marks[1] + 1
        printed += len(spelt)
    else:
        role, begin = names[first], 1
    text = decode(ids[begin : marks[-1]])
    under = decode(ids[loss])
    return role, unescape(text), unescape(under), printed + len(text)


def _digested(path: str):
    def run(batches):
        tokenizer = _tokenizer(path)

        def decode(ids):
            return tokenizer.decode(ids.tolist(), skip_special_tokens=False) if len(ids) else ""

        now, state = None, None

        def done():
            turns, sha, loss_chars, loss_sha, chars = state
            row = [now[0], turns, sha.hexdigest(), loss_chars, loss_sha.hexdigest(), chars]
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            kind = batch.column(0).type
            for k, conv in enumerate(batch.column(0).to_pylist()):
                if now != (conv,):
                    if now is not None:
                        yield done()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids, loss = (np.asarray(batch.column(c)[k].values) for c in (1, 2))
                role, text, under, chars = _turn(ids, loss.astype(bool), decode)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(under)
                state[3].update(under.encode())
                state[4] += chars
        if now is not None:
            yield done()

    return run


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """One row per conversation, from its ids and masks: turns, their hash, the characters and
    the hash of all text under the mask, and the characters of the printed form."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("tie")]
    rows = formatted.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "ids", "loss")
    kind = formatted.schema["conv_id"].dataType.simpleString()
    form = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return rows.mapInArrow(_digested(tokenizer), form)


_PLANTED = r"\### Assistant: </turn> ok"

_ORACLE = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{_PLANTED}'),
sized AS (
  SELECT *, length(regexp_replace(text, '(\\|###|</role>|</turn>)', '\\\1', 'g')) + 8
    + CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15
      ELSE 17 + length(regexp_replace(role, '(\\|###|</role>|</turn>)', '\\\1', 'g')) END AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op2_token_chat", _ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and one planted one, formatted and read back."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", _PLANTED), (-7, 1, "assistant", _PLANTED)], turns.schema)
    return read_back(written(format_turns(turns.unionByName(planted), path), "chat"), path)
