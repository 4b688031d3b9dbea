"""MD5 of large files: read in splits by many tasks, hashed slice after slice.

MD5 takes the bytes in order, so the slices of one file wait for each other, but no task needs more
than one of them: a round hashes one slice of every file and hands the 16-byte state on.
"""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut_lineage, stored_copy

SLICE = 128 << 20
#: Bytes of a row between the reading and the hashing tasks, at most.
PIECE = 4 << 20
#: Names by which Spark's text reader would unpack a file.
PACKED = r"\.(gz|gzip|bz2|deflate|snappy|lz4|zst|zstd|passthrough)$"

_START = struct.pack("<4I", 0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: The byte order mark, which the text reader drops from the start of a file.
_MARK = b"\xef\xbb\xbf"
_PIECES = "file string, start long, seq long, n long, bytes binary, slice long"
_STATES = "file string, start long, seq long, bytes binary, size long, done long, state binary"


def compress(state: bytes, blocks: bytes) -> bytes:
    """MD5 state after further blocks of 64 bytes, as RFC 1321 has it."""
    turns = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
    places = [lambda i: i, lambda i: 5 * i + 1, lambda i: 3 * i + 5, lambda i: 7 * i]
    steps = [(i, places[i // 16](i) % 16, turns[i // 16][i % 4], int(abs(np.sin(i + 1.0)) * 2**32)) for i in range(64)]
    a, b, c, d = first = struct.unpack("<4I", state)
    for words in struct.iter_unpack("<16I", blocks):
        for i, place, turn, sine in steps:
            if i < 16:
                f = d ^ (b & (c ^ d))
            elif i < 32:
                f = c ^ (d & (b ^ c))
            elif i < 48:
                f = b ^ c ^ d
            else:
                f = c ^ (b | (d ^ 0xFFFFFFFF))
            f = (a + f + words[place] + sine) & 0xFFFFFFFF
            a, d, c, b = d, c, b, (b + (f << turn | f >> (32 - turn))) & 0xFFFFFFFF
        a, b, c, d = first = [(x + y) & 0xFFFFFFFF for x, y in zip(first, (a, b, c, d))]
    return struct.pack("<4I", *first)


def compressor() -> Callable[[bytes, bytes], bytes]:
    """``compress`` by the library that Python's hashlib stands on, or as above where that cannot be called."""
    try:
        import _hashlib

        update = ctypes.CDLL(_hashlib.__file__).MD5_Update
    except (ImportError, OSError, AttributeError):
        return compress

    def native(state: bytes, blocks: bytes) -> bytes:
        # MD5_CTX: four words of state, two of length, sixteen of data, one count; whole blocks leave no data behind.
        context = (ctypes.c_uint32 * 32)(*struct.unpack("<4I", state))
        if not update(context, blocks, ctypes.c_size_t(len(blocks))):
            raise RuntimeError("MD5_Update failed")
        return struct.pack("<4I", *context[:4])

    try:
        known = native(_START, padded(b"abc", 3)).hex() == "900150983cd24fb0d6963f7d28e17f72"
    except RuntimeError:
        known = False
    return native if known else compress


def padded(tail: bytes, size: int) -> bytes:
    """The last blocks of a message of ``size`` bytes that ends with ``tail``."""
    return tail + b"\x80" + bytes((55 - size) % 64) + struct.pack("<Q", size * 8 % 2**64)


def _cut(slice_bytes: int, piece_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines of splits to pieces of their bytes; all but a file's first line bring the line feed before them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seq, done, head = None, 0, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            files, starts, lengths, lines = batch.columns
            places = files.dictionary_encode().indices.to_numpy(), starts.to_numpy()
            edges = np.flatnonzero((np.diff(places[0]) != 0) | (np.diff(places[1]) != 0)) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                file, start, length = files[low].as_py(), starts[low].as_py(), lengths[low].as_py()
                if (file, start) != split:
                    split, seq, done, head = (file, start), 0, 0, start == 0
                data = b"\n".join(lines.slice(low, high - low).to_pylist())
                data, head = data if head else b"\n" + data, False
                for at in range(0, len(data), piece_bytes):
                    piece = data[at : at + piece_bytes]
                    # The line that leaves a split belongs to it: its last slice takes that too.
                    number = (start + min(done, length - 1)) // slice_bytes
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([file]), pa.array([start]), pa.array([seq]), pa.array([len(piece)]),
                            pa.array([piece], pa.binary()), pa.array([number]),
                        ],
                        ["file", "start", "seq", "n", "bytes", "slice"],
                    )
                    seq, done = seq + 1, done + len(piece)

    return cut


def _states(rows: list[tuple]) -> pa.RecordBatch:
    file, tail, size, done, state = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(file), pa.array([-1] * len(rows), pa.int64()), pa.array([-1] * len(rows), pa.int64()),
            pa.array(tail, pa.binary()), pa.array(size, pa.int64()), pa.array(done, pa.int64()), pa.array(state, pa.binary()),
        ],
        ["file", "start", "seq", "bytes", "size", "done", "state"],
    )


def _advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A file's state and, after it, the pieces of its next slice to the state behind them."""
    digest, now = compressor(), None
    for batch in batches:
        for i in range(batch.num_rows):
            file, start, _, data, size, done, state = (column[i].as_py() for column in batch.columns)
            if start < 0:
                if now:
                    yield _states([now])
                now = (file, data, size, done, state)
                continue
            file, tail, size, done, state = now
            data, done = tail + data, done + len(data)
            whole = len(data) & ~63
            now = (file, data[whole:], size, done, digest(state, data[:whole]) if whole else state)
    if now:
        yield _states([now])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = compressor()
    for batch in batches:
        hashes = []
        for file, tail, size, done, state in zip(*(column.to_pylist() for column in batch.columns)):
            if done not in (size, size - 1):
                raise ValueError(f"{file}: {done} of {size} bytes read")
            # A line feed at the very end starts no line, so no piece brought it.
            tail += b"\n" * (size - done)
            hashes.append(digest(state, padded(tail, size)).hex())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.string())], ["file", "hash"])


def slice_counts(files: DataFrame, slice_bytes: int) -> list[int]:
    """How many of the listed files (``size``) have a slice more than 0, 1, 2 and so on slices."""
    number = F.floor((F.col("size") - 1) / slice_bytes).alias("last")
    counts = files.groupBy(number).count().collect()
    return [sum(r["count"] for r in counts if r["last"] >= k) for k in range(max((r["last"] for r in counts), default=-1) + 1)]


def file_hashes(files: DataFrame, texts: DataFrame, counts: list[int], slice_bytes: int = SLICE, piece_bytes: int = PIECE) -> DataFrame:
    """``file``, ``hash`` of the listed files (``file``, ``size``), whose lines ``texts`` reads as text.

    The bytes are read once and kept in the shared folder for the rounds, one for each of ``slice_counts``.
    """
    lines = texts.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_block_length").alias("length"),
        F.col("value").cast("binary").alias("line"),
    )
    with stored_copy(lines.mapInArrow(_cut(slice_bytes, piece_bytes), _PIECES), "pieces", ["slice"], "snappy") as pieces:
        read = pieces.groupBy("file").agg(F.sum("n").alias("read"))
        marked = F.col("size") - F.coalesce("read", F.lit(0)) >= len(_MARK)
        lead = F.when(marked, F.lit(_MARK)).otherwise(F.lit(b""))
        states = files.join(read, "file", "left").select(
            "file", F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("seq"), lead.alias("bytes"),
            "size", F.length(lead).cast("long").alias("done"), F.lit(_START).alias("state"),
        )
        for k, count in enumerate(counts):
            more = F.col("size") > k * slice_bytes
            part = pieces.where(F.col("slice") == k).drop("n", "slice").unionByName(states.where(more), allowMissingColumns=True)
            # Four places a file: few files share one.
            dealt = part.select(*states.columns).repartition(4 * count, "file").sortWithinPartitions("file", "start", "seq")
            states = cut_lineage(dealt.mapInArrow(_advance, _STATES).unionByName(states.where(~more)), "states")
    return states.select("file", "bytes", "size", "done", "state").mapInArrow(_finish, "file string, hash string")
