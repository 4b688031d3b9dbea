"""Token counts of whole texts: batches go to the tokenizer's library and only lengths come back.

Texts are split at safe boundaries and the pieces' lengths added up, so the library never holds
the encoding of a long text, and a piece that a task has met before is not encoded again. The
other pieces are gathered into batches of about ``BATCH`` bytes, whatever their number. A boundary
is safe where the vocabulary's own rule always starts a new word: before an ASCII white space that
follows a letter, digit, mark or sign, or between a letter and a punctuation mark of the stable
sets below. Texts are cut before every space behind an ASCII sign; a piece that is then longer
than ``PIECE`` characters is cut at the other boundaries too, and a stretch without any stays in
one piece. That rule is the byte-level pattern's, which looks at no character before the word; a
file with another rule, with a normaliser, or a sentencepiece model is given whole texts.

``.json`` files are read by ``tokenizers``, ``.model`` files by ``sentencepiece``; no begin, end or
other special tokens are added, special strings inside texts count as the library counts them by
default, and nothing is truncated or padded.

Nulls: a null text is empty (0 bytes, 0 tokens), a null id is kept. Repeated rows give repeated
results. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import texts as T
from paperloom.llm.store import query, table

BATCH = 1 << 20
PIECE = 1 << 15
HELD = 1 << 20  # pieces whose lengths a task remembers: some 100 MB
LIMIT = 512

#: Letters and marks that every version of the character tables agrees on.
_LETTER = r"[a-zA-ZÀ-ÖØ-öø-ɏЀ-ҁҊ-ӿぁ-ゖァ-ヺ一-龥가-힣]"
_MARK = r"[.,;:!?()。、「」！？：；]"
_SAFE = regex.compile(rf"(?<=[\p{{L}}\p{{N}}\p{{P}}\p{{S}}])(?=[\x20\x09-\x0D])|(?<={_LETTER})(?={_MARK})")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Parts of ``text`` of ``size`` characters and as few more as lead to a safe boundary."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def splits_safely(path: str) -> bool:
    """Whether a ``tokenizers`` file starts words by the byte-level pattern and by nothing else."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    rule = found.get("pre_tokenizer") or {}
    plain = rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space")
    added = found.get("added_tokens") or []
    apart = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and _SAFE.search(t["content"]) is None for t in added)
    limits = found.get("truncation") or found.get("normalizer") or found["model"].get("dropout")
    return bool(plain and apart and not limits)


def _lengths(path: str) -> Callable[[list[str]], list[int]]:
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts cut before every space behind an ASCII sign, and the text that each part is of."""
    data, bounds = T.raw(texts)
    start = np.zeros(len(data), bool)
    if len(data):
        start[1:] = (data[1:] == 32) & (data[:-1] > 32) & (data[:-1] < 127)
        start[bounds[:-1][np.diff(bounds) > 0]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts, len(data)).astype(np.int32)
    parts = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return parts, np.searchsorted(bounds, starts, side="right") - 1


def _filled(texts: Iterator[tuple[int, str]], batch: int) -> Iterator[tuple[list[int], list[str]]]:
    """Lists of numbered texts of about ``batch`` characters."""
    owners, held, size = [], [], 0
    for owner, text in texts:
        owners.append(owner)
        held.append(text)
        size += len(text)
        if size >= batch:
            yield owners, held
            owners, held, size = [], [], 0
    if held:
        yield owners, held


class Counter:
    """Numbers of tokens of texts; a task's memory of pieces is bounded."""

    def __init__(self, path: str, piece: int, batch: int):
        self.lengths, self.piece, self.batch = _lengths(path), piece, batch
        self.split = path.endswith(".json") and splits_safely(path)
        self.known: dict[str, int] = {}

    def _sums(self, texts: list[str], split: bool) -> np.ndarray:
        counts = np.zeros(len(texts), np.int64)
        parts = ((k, p) for k, t in enumerate(texts) for p in (pieces(t, self.piece) if split else (t,)))
        for owners, held in _filled(parts, self.batch):
            np.add.at(counts, owners, self.lengths(held))
        return counts

    def counts(self, texts: pa.Array) -> np.ndarray:
        if not self.split:
            return self._sums(texts.to_pylist(), False)
        parts, owners = words(texts)
        distinct, codes = T.coded(parts)
        distinct = distinct.to_pylist()
        if len(self.known) + len(distinct) > HELD:
            self.known.clear()
        new = [p for p in distinct if p not in self.known]
        self.known.update(zip(new, self._sums(new, True).tolist(), strict=True))
        sizes = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        return np.bincount(owners, weights=sizes[codes], minlength=len(texts)).astype(np.int64)


def _counted(path: str, piece: int, batch_size: int):
    def run(batches):
        counter = Counter(path, piece, batch_size)
        for batch in T.slices(batches, 4 * batch_size):
            texts = T.column(batch, "text")
            sizes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counter.counts(texts))], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", piece: int = PIECE, batch: int = BATCH) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs``; ``tokenizer`` is a vocabulary file
    that every executor can open."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"
    return rows.mapInArrow(_counted(tokenizer, piece, batch), schema)


@query("op13_token_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text, and whether it is over the limit."""
    import public_tokenizers

    found = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > LIMIT)
