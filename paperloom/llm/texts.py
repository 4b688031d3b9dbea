"""Words, lines and bytes of Arrow text columns as flat numpy arrays."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def multipliers(n: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * _ODD) | np.uint64(1)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column; null is the empty text."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.string()).fill_null("")


def give_back() -> None:
    """Return freed memory to the system: a worker that is used again keeps it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches, max_bytes: int = 8 << 20):
    """Record batches of about ``max_bytes`` at most; a longer text stands alone."""
    give_back()
    for batch in batches:
        start, n = 0, batch.num_rows
        while start < n:
            rows = n - start
            while rows > 1 and batch.slice(start, rows).get_total_buffer_size() and _bytes(batch, start, rows) > max_bytes:
                rows = (rows + 1) // 2
            yield batch.slice(start, rows)
            start += rows


def _bytes(batch: pa.RecordBatch, start: int, rows: int) -> int:
    return batch.slice(start, rows).nbytes


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes one after the other, and each text's bounds in them."""
    texts = pa.concat_arrays([texts]) if texts.offset == 0 else pa.concat_arrays([texts, texts.slice(0, 0)])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _parts(lists: pa.ListArray, keep: pa.Array, flat: pa.Array) -> tuple[pa.Array, np.ndarray]:
    offsets = np.asarray(lists.offsets).astype(np.int64)
    kept = np.concatenate([[0], np.cumsum(np.asarray(keep))])
    return flat.filter(keep), kept[offsets - offsets[0]]


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of characters other than space and U+0009 to U+000D, and each text's bounds in them."""
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(1, np.int64)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    return _parts(lists, pc.greater(pc.binary_length(flat), 0), flat)


def lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Parts between line feeds that hold a word, and each text's bounds in them."""
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(1, np.int64)
    lists = pc.split_pattern(texts, "\n")
    flat = lists.flatten()
    return _parts(lists, pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0), flat)


def coded(flat: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values, and the place of each value among them."""
    d = flat.dictionary_encode()
    return d.dictionary, np.asarray(d.indices).astype(np.int64)


def owners(bounds: np.ndarray) -> np.ndarray:
    """The number of the text that each part belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` within each text."""
    run = np.concatenate([[0], np.cumsum(values)])
    return run[bounds[1:]] - run[bounds[:-1]]


def repeats(keys: np.ndarray) -> np.ndarray:
    """How often each key occurs among all keys."""
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[back]


def windows(codes: np.ndarray, bounds: np.ndarray, size: int, salt: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``size`` neighbouring codes, and whether all of them are in one text."""
    n = len(codes)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    m = multipliers(size + 1)
    hashes = np.zeros(n - size + 1, np.uint64)
    u = codes.astype(np.uint64)
    for k in range(size):
        hashes += u[k : n - size + 1 + k] * m[k]
    if salt is not None:
        hashes += salt[: n - size + 1].astype(np.uint64) * m[size]
    own = owners(bounds)
    return mix64(hashes), own[: n - size + 1] == own[size - 1 :]


def covered(marked: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a marked window of ``size`` places."""
    step = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(marked)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + size, -1)
    return np.cumsum(step[:n]) > 0
