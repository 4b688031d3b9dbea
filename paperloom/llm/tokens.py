"""Token ids in a binary file format of independently coded, checksummed blocks.

Every whole text is encoded by the ``tokenizers`` library without special tokens, one end id is
appended, and the ids are written in ascending order of the document id (nulls first; equal ids
in the order of their texts). The files are Parquet in a folder: a row is a segment of
consecutive documents with their ids and lengths, the segment's order-0 table and its coded
blocks (``rangecoder``). A segment holds about ``SEGMENT`` ids, or one longer document, so a task
holds one segment at a time. Where a document starts follows from the segments' lengths.

Words repeat, so each Python worker encodes a piece of text between single spaces, without the
punctuation and line feeds beside it, once and reuses its ids, also in its later tasks. Texts with
two spaces in a row, with the vocabulary's special strings or with a token that holds a space after
its first byte are encoded as one: no merge crosses a piece's edge in the others.

Nulls: a null text is empty (its end id alone), a null id is kept. Repeated rows are written
repeatedly. An empty table gives no segment. Other columns are ignored.
"""

from __future__ import annotations

import os
import string
import zlib
from functools import cached_property
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm import rangecoder
from paperloom.llm import texts as T
from paperloom.llm.store import folder as new_folder
from paperloom.llm.store import query, table, written

END_ID = 0
SEGMENT = 1 << 22
HELD = 1 << 20  # words that a worker remembers, at about 40 bytes each
HELD_BYTES = 24 << 20  # of their text
BATCH = 512  # pieces that the library gets at once
JOINED = 64  # of them in one string
CHUNKS = 64  # arrays of remembered words before they are joined
PAIRS = 1 << 20  # neighbouring bytes that are looked up at once


def _alphabet() -> dict[str, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


_BYTES = _alphabet()


def _token_bytes(token: str) -> bytes:
    """The bytes that a token of a byte-level vocabulary stands for."""
    try:
        return bytes(map(_BYTES.__getitem__, token))
    except KeyError:
        return token.encode()


def joining(vocabulary: list[str]) -> list[bytes]:
    """The shortest tokens with a space after the first byte; all others hold one of them."""
    found: list[bytes] = [b"  "]
    spaced = {t for t in map(_token_bytes, vocabulary) if b" " in t[1:]}
    for token in sorted(spaced, key=lambda t: (len(t), t)):
        if not any(f in token for f in found):
            found.append(token)
    return found


def _parting(vocabulary: list[str]) -> np.ndarray:
    """For two neighbouring bytes, whether the library's own rule or its merges part them in any text.

    No token may hold the two, one of them is ASCII punctuation or white space, and what stands on
    either side alone is split as it is here: 1 always, 2 after a byte 0xC3 (a Latin letter of two
    bytes), 3 after a visible ASCII character (a single line feed before a letter or digit).
    """
    held = np.zeros((256, 256), bool)
    found = list(map(_token_bytes, vocabulary))
    codes = np.frombuffer(b"".join(found) or b"\0", np.uint8)
    inside = np.ones(len(codes), bool)
    inside[np.cumsum([len(t) for t in found]) - 1] = False  # the last bytes of tokens
    inside = np.flatnonzero(inside[:-1])
    held[codes[inside], codes[inside + 1]] = True
    byte = np.arange(256)
    word = (byte >= 128) | np.isin(byte, np.frombuffer(string.ascii_letters.encode() + string.digits.encode(), np.uint8))
    right = (byte < 128) | (byte >= 192)
    left = byte > 32
    for side in (left, right):
        side[ord("'")] = False  # contractions look at both sides of it
    kind = np.where(byte < 128, 1, 2)[:, None] * (left[:, None] & right & ~(word[:, None] & word) & ~held)
    kind[10] = 3 * (word & ((byte < 128) | (byte == 0xC3)) & ~held[10])
    return kind.astype(np.uint8).ravel()


def _known_rule(tokenizer) -> bool:
    """Whether the tokenizer splits texts by the rule that ``_parting`` knows."""
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel

    rule, model = tokenizer.pre_tokenizer, tokenizer.model
    plain = isinstance(rule, ByteLevel) and rule.use_regex and not rule.add_prefix_space and tokenizer.normalizer is None
    return plain and isinstance(model, BPE) and not (model.dropout or model.ignore_merges)


def _gathered(ids: np.ndarray, starts: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``own`` of ``ids`` one after the other, and their bounds."""
    begin = starts.take(own, mode="clip")
    size = starts.take(own + 1, mode="clip") - begin
    ends = np.cumsum(size)
    begin -= ends
    begin += size
    place = np.repeat(begin, size)
    place += np.arange(len(place))
    return ids.take(place, mode="clip"), np.concatenate([[0], ends])


def _room(held: np.ndarray, used: int, needed: int) -> np.ndarray:
    """``held``, or a longer copy of its first ``used`` entries, with room for ``needed``."""
    if needed <= len(held):
        return held
    longer = np.empty(needed + needed // 4, held.dtype)
    longer[:used] = held[:used]
    return longer


class PieceEncoder:
    """Ids of texts by way of their words; the memory of words is bounded.

    Distinct pieces between single spaces are cut where the library always parts them
    (``_parting``), as before punctuation. The memory is an Arrow array of such words, a flat array
    of their ids and how often each was met; when it is full, the half that was met more often stays.
    New words go to the library many in one string: no token crosses the space, or line feed,
    between two of them, so the tokens' widths in bytes tell where each word ends.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.whole = joining(list(vocabulary)) + [t.encode() for t in special]
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(_token_bytes(token))
        self.parting = _parting(list(vocabulary)) if _known_rule(self.tokenizer) else None
        self.forget()

    def forget(self) -> None:
        self.pieces = pa.chunked_array([], pa.string())
        self.ids, self.starts, self.met = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _learn(self, words: list[pa.Array], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Arrays have room for more than they hold, so that most slices only add to them."""
        n, used = len(self.pieces), int(self.starts[len(self.pieces)])
        chunks = [*self.pieces.chunks, *words]
        self.pieces = pa.chunked_array([pa.concat_arrays(chunks)] if len(chunks) > CHUNKS else chunks)
        self.ids = _room(self.ids, used, used + len(ids))
        self.ids[used : used + len(ids)] = ids
        self.starts, self.met = _room(self.starts, n + 1, n + 1 + len(sizes)), _room(self.met, n, n + len(sizes))
        self.starts[n + 1 : n + 1 + len(sizes)] = used + np.cumsum(sizes)
        self.met[n : n + len(sizes)] = 1

    def _halve(self) -> None:
        keep = np.sort(np.argsort(-self.met[: len(self.pieces)], kind="stable")[: HELD // 2])
        self.ids, self.starts = _gathered(self.ids, self.starts, keep)
        self.met = self.met[keep] >> 1
        self.pieces = pa.chunked_array([self.pieces.combine_chunks().take(pa.array(keep))], pa.string())
        if self.pieces.nbytes > HELD_BYTES // 2:
            self.forget()

    def _lists(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that are encoded one by one, and how many each has."""
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a in range(0, len(pieces), BATCH):
            found = self._lists(pieces.slice(a, BATCH).to_pylist())
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.int32, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    def _joined(self, pieces: pa.Array, lead: str = "") -> tuple[np.ndarray, np.ndarray]:
        """As ``_alone``, for pieces that start with a space and go on after it, or that neither start
        nor end with white space and get a line feed as ``lead``."""
        led = pc.binary_join_element_wise(lead, pieces, "") if lead else pieces
        data, bounds = T.raw(led)
        data, cuts, ids = data.tobytes(), [*range(0, len(pieces), JOINED), len(pieces)], [np.zeros(0, np.int32)]
        places = [bounds[c] for c in cuts]
        texts = [data[a:b] for a, b in pairwise(places)]
        if any(other in text for other in self.whole for text in texts):  # made by joining
            return self._alone(pieces)
        for a in range(0, len(texts), BATCH // JOINED):
            found = self._lists([t.decode() for t in texts[a : a + BATCH // JOINED]])
            ids.append(np.fromiter(chain.from_iterable(found), np.int32, sum(map(len, found))))
        ids = np.concatenate(ids)
        ends = np.concatenate([[0], np.cumsum(self.width[ids])])
        at = np.searchsorted(ends, bounds)
        if ends[-1] != bounds[-1] or (ends[at] != bounds).any():
            return self._alone(pieces)
        if not lead:
            return ids, np.diff(at)
        if (ends[at[:-1] + 1] != bounds[:-1] + len(lead)).any():
            return self._alone(pieces)
        return np.delete(ids, at[:-1]), np.diff(at) - 1

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where the memory holds each of the distinct ``pieces``; it learns those it does not."""
        places = self._known(pieces)
        missing = np.flatnonzero(places < 0)
        if len(self.pieces) + len(missing) > HELD or self.pieces.nbytes + pieces.nbytes > HELD_BYTES:
            self._halve()
            places = self._known(pieces)
            missing = np.flatnonzero(places < 0)
        self.met[places[places >= 0]] += 1
        if not len(missing):
            return places
        new = pieces.take(pa.array(missing))
        data, bounds = T.raw(new)
        many = np.diff(bounds) > 0
        first, last = (data[np.where(many, at, 0)] if len(data) else np.zeros(len(new), np.uint8) for at in (bounds[:-1], bounds[1:] - 1))
        spaced = (first == 32) & (np.diff(bounds) > 1)
        plain = many & (first > 32) & (first < 127) & (last > 32) & (last < 127)
        groups = [np.flatnonzero(g) for g in (spaced, plain & ~spaced, ~(spaced | plain))]
        words = [new.take(pa.array(g)) for g in groups]
        parts = [self._joined(words[0]), self._joined(words[1], "\n"), self._alone(words[2])]
        places[missing[np.concatenate(groups)]] = np.arange(len(self.pieces), len(self.pieces) + len(new))
        self._learn(words, *map(np.concatenate, zip(*parts, strict=True)))
        return places

    def _known(self, pieces: pa.Array) -> np.ndarray:
        places = np.full(len(pieces), -1, np.int64)
        found = pc.index_in(self.pieces, value_set=pieces).combine_chunks()
        held = np.flatnonzero(found.is_valid())
        places[np.asarray(found.drop_null())] = held
        return places

    def _words(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces' words one after the other, and each piece's bounds in them."""
        data, bounds = T.raw(pieces)
        if self.parting is None or len(data) < 2:
            return pieces, np.arange(len(pieces) + 1)
        at = np.concatenate([a + np.flatnonzero(self._kinds(data[a : a + PAIRS], data[a + 1 : a + PAIRS + 1])) for a in range(0, len(data) - 1, PAIRS)])
        kind, before = self._kinds(data[at], data[at + 1]), data[np.maximum(at - 1, 0)]
        at = at[(kind == 1) | (kind == 2) & (before == 0xC3) | (kind == 3) & (before > 32) & (before < 127)]
        starting = np.zeros(len(data) + 1, bool)
        starting[at + 1] = True
        starting[bounds] = True
        edges = np.flatnonzero(starting)
        words = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data))
        return words, np.searchsorted(edges, bounds)

    def _kinds(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left[: len(right)].astype(np.int64)
        pairs <<= 8
        pairs |= right
        return self.parting.take(pairs, mode="clip")

    def _wholes(self, texts: pa.Array, pieces: pa.Array) -> np.ndarray:
        """Which texts hold one of ``whole``; a string is looked for where their distinct pieces allow it."""
        found, pieces, data = np.zeros(len(texts), bool), pieces.cast(pa.binary()), texts.cast(pa.binary())
        for other in self.whole:
            parts = other.split(b" ")
            if len(parts) == 1:
                possible = pc.any(pc.match_substring(pieces, other)).as_py()
            else:  # what stands between two of its spaces is a piece
                possible = all(pc.any(pc.equal(pieces, part)).as_py() for part in set(parts[1:-1]))
            if possible:
                found |= np.asarray(pc.match_substring(data, other)).astype(bool)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and each text's bounds in them."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        lists = pc.split_pattern(texts, " ")
        flat, at = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
        at = at - at[0]
        pieces, codes = T.coded(flat)
        whole = self._wholes(texts, pieces)
        if whole.any():
            return self._mixed(texts, whole)
        first = np.zeros(len(flat), bool)
        first[at[:-1]] = True
        # A piece after a space takes the space along.
        spaced = pc.binary_join_element_wise("", pieces, " ")
        used = np.unique(codes[first])
        words, bounds = self._words(pa.concat_arrays([spaced, pieces.take(pa.array(used))]))
        distinct, own = T.coded(words)
        places = self._places(distinct)[own]
        ids, ends = _gathered(self.ids, self.starts, places)
        starts = ends[bounds]
        starting = np.zeros(len(spaced), np.int64)
        starting[used] = np.arange(len(spaced), len(spaced) + len(used))
        codes[first] = starting[codes[first]]
        ids, ends = _gathered(ids, starts, codes)
        return ids, ends[at]

    def _mixed(self, texts: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest, rest_at = self.encode(texts.filter(pa.array(~whole)))
        alone = iter(self._lists(texts.filter(pa.array(whole)).to_pylist()))
        parts, k = [], 0
        for w in whole.tolist():
            if w:
                parts.append(np.array(next(alone), np.int32))
            else:
                parts.append(rest[rest_at[k] : rest_at[k + 1]])
                k += 1
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


class _Worker:
    """What a Python worker keeps of one broadcast: the encoder, made where it is first used."""

    def __init__(self, path: str):
        self.path = path

    @cached_property
    def encoder(self) -> PieceEncoder:
        return PieceEncoder(self.path)


def _with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, at[1:], end_id), at + np.arange(len(at))


def _segments(shared, end_id: int):
    def run(batches):
        encoder, number = shared.value.encoder, 0
        docs, sizes, held, waiting = [], [], [], 0

        def segment():
            ids = np.concatenate(held)
            held.clear()
            T.give_back()
            (seen, freq), blocks = rangecoder.encode(ids)
            row = [
                pa.array([part], pa.int32()),
                pa.array([number], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, sum(map(len, docs))], pa.int32()), pa.concat_arrays(docs)),
                pa.array([np.concatenate(sizes)], pa.list_(pa.int64())),
                pa.array([seen.astype("<u2").tobytes()], pa.binary()),
                pa.array([(freq - 1).astype("<u2").tobytes()], pa.binary()),
                pa.array([blocks], pa.list_(pa.binary())),
            ]
            return pa.RecordBatch.from_arrays(row, ["part", "number", "docs", "sizes", "ids", "freqs", "blocks"])

        for batch in T.slices(batches, 4 << 20):
            part = batch.column(2)[0].as_py()
            ids, at = _with_end(*encoder.encode(T.column(batch, "text")), end_id)
            docs.append(batch.column(0))
            sizes.append(np.diff(at))
            held.append(ids)
            waiting += len(ids)
            if waiting >= SEGMENT:
                yield segment()
                number, waiting = number + 1, 0
                docs.clear(), sizes.clear()
        if docs:
            yield segment()

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_column: str = "doc_id", end_id: int = END_ID) -> None:
    """Encode every text of ``docs`` and write the coded ids to ``folder``."""
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col("text").cast("string").alias("text"))
    # One long document is one row; many rows of one id are told apart by their texts' hashes.
    ordered = docs.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"part int, number bigint, docs array<{id_type}>, sizes array<bigint>, ids binary, freqs binary, blocks array<binary>"
    # A worker keeps the value of a broadcast from task to task, and with it the words it knows.
    shared = docs.sparkSession.sparkContext.broadcast(_Worker(tokenizer))
    rows = ordered.withColumn("part", F.spark_partition_id()).mapInArrow(_segments(shared, end_id), schema)
    rows.write.option("compression", "uncompressed").parquet(folder)
    shared.unpersist()


def _read(batches):
    T.give_back()
    for batch in batches:
        for row in range(batch.num_rows):
            seen, freq = (np.frombuffer(batch.column(c)[row].as_py(), "<u2").astype(np.int64) for c in (4, 5))
            ids = rangecoder.decode((seen, freq + 1), batch.column(6)[row].as_py())
            docs, sizes = batch.column(2)[row].values, np.asarray(batch.column(3)[row].values).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
            same = [pa.array(np.full(len(sizes), batch.column(c)[row].as_py())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([same[0].cast(pa.int32()), same[1], docs, pa.array(at[:-1]), lists], ["part", "number", "doc_id", "place", "ids"])


def read_tokens(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, ids): the ids of every document with its end id, and how many ids all
    documents before it have. With ``digest``, ``n_tokens`` and ``ids_crc32`` in place of them."""
    rows = spark.read.parquet(folder)
    id_type = rows.schema["docs"].dataType.elementType.simpleString()
    reader, form = (_read_digest, "n_tokens bigint, ids_crc32 bigint") if digest else (_read, "ids array<int>")
    found = rows.mapInArrow(reader, f"part int, number bigint, doc_id {id_type}, place bigint, {form}")
    sizes = rows.select("part", "number", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    sizes = written(sizes, "segments")
    before = Window.unboundedPreceding, -1
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("base"))
    sizes = sizes.withColumn("within", F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("number").rowsBetween(*before)), F.lit(0)))
    sizes = sizes.join(parts, F.col("part") == F.col("p"))
    sizes = sizes.select(F.col("part").alias("s_part"), F.col("number").alias("s_number"), (F.col("base") + F.col("within")).alias("offset"))
    found = found.join(sizes, (F.col("part") == F.col("s_part")) & (F.col("number") == F.col("s_number")))
    rest = [c for c in found.columns if c not in ("part", "number", "doc_id", "place", "s_part", "s_number", "offset")]
    return found.select("doc_id", (F.col("offset") + F.col("place")).alias("start"), *rest)


def _read_digest(batches):
    for batch in _read(batches):
        ids = batch.column(4)
        at, data = np.asarray(ids.offsets), np.asarray(ids.values).astype("<u4")
        crc = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        columns = [*batch.columns[:4], pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:4], "n_tokens", "ids_crc32"])


@query("op9_context_coder")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to the file format and read back."""
    import public_tokenizers

    folder = new_folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, folder, digest=True)
