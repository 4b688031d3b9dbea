"""Removal of every byte covered by a repeated string of ``LENGTH`` bytes, by suffix sorting.

Texts are bytes; strings never cross texts. The work runs in three steps.

1. Anchors. Of the ``ANCHOR``-byte strings inside a window of ``LENGTH`` bytes, the leftmost one of
   the smallest hash is the window's anchor. Equal windows have equal anchors at equal places, so
   only windows around the same anchor string can be equal. Neighbouring windows with one anchor
   make a run; the bytes that a run's windows cover are its context. Spark counts anchors and
   contexts: an anchor seen once repeats nothing, and a context seen twice repeats all its windows.
2. Suffix sorting. Where an anchor has several different contexts, their bytes are fetched once
   per context. A task takes contexts of whole anchors and sorts what follows the anchor, and what
   precedes it read backwards, by the Lyndon-grouping suffix array of ``lyndon``. In both orders,
   contexts that agree on the bytes a window needs are neighbours; two windows at one place of
   their anchor are equal exactly if they fall into the same stretch of both orders. The orders
   and the agreements come from the bytes themselves, not from hashes.
   Anchors with more than ``HOT`` contexts would fill a task; their windows are counted by Spark
   one by one instead (SHA-256 of the window), which needs no group.
3. Every text's repeated windows are joined to it, and the bytes they cover are removed.

``LENGTH`` is 200 and windows are judged on the input. Texts of under 200 bytes keep everything.
Nulls: a null text is empty, null ids are carried. Repeated rows repeat each other's strings and
give repeated results. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import texts as T
from paperloom.llm.lyndon import suffix_array
from paperloom.llm.store import query, table, written

LENGTH = 200
ANCHOR = 32
HOT = 20_000
BATCH = 20_000  # contexts that are sorted together
_SYMBOL = 16

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


# --- step 1: anchors ---------------------------------------------------------------------


class _Hasher:
    """Hashes of byte strings from prefix sums modulo 2 ** 64; ``kind`` picks independent ones."""

    def __init__(self, data: np.ndarray, kind: int):
        n = len(data)
        values = T.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * kind + 0xD1342543DE82EF95))
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * power[:n], out=self.sums[1:])
        self.inverse = np.full(n + 1, _INVERSE, np.uint64)
        self.inverse[0] = 1
        self.inverse = np.multiply.accumulate(self.inverse)

    def each(self, size: int) -> np.ndarray:
        """Hashes of all strings of one size."""
        return T.mix64((self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.sums) - size])

    def some(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return T.mix64((self.sums[end] - self.sums[start]) * self.inverse[start])


def _least_places(values: np.ndarray, size: int) -> np.ndarray:
    """Place of the leftmost smallest value in every window of ``size`` values."""
    at, best, span = np.arange(len(values), dtype=np.int32), values, 1
    while span < size:
        step = min(span, size - span)
        left, right = best[:-step], best[step:]
        at = np.where(right < left, at[step:], at[:-step])
        best = np.minimum(left, right)
        span += step
    return at


def text_runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (text, first window, windows, bytes from the first window
    to the anchor, anchor hash, context hash), places counted from the text's start."""
    if len(data) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    hashes = _Hasher(data, 1)
    anchors = hashes.each(ANCHOR)
    at = _least_places(anchors, LENGTH - ANCHOR + 1)
    own = T.owners(bounds)
    whole = own[: len(at)] == own[LENGTH - 1 :]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (own[1 : len(at)] != own[: len(at) - 1])
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new & whole)
    windows = np.bincount(run[whole], minlength=run[-1] + 1)[run[first]]
    before = at[first] - first
    context = _Hasher(data, 2).some(first, first + windows - 1 + LENGTH)
    context = T.mix64(context + windows.astype(np.uint64) * np.uint64(0x9E3779B1) + (before.astype(np.uint64) << np.uint64(40)))
    text = own[first]
    return text, first - bounds[text], windows, before, anchors[at[first]], context


_RUN = "text_id bigint, first int, windows smallint, before smallint, anchor bigint, context bigint"


def _emitted_runs(batches):
    for batch in T.slices(batches, 4 << 20):
        data, bounds = T.raw(T.column(batch, "text"))
        text, first, windows, before, anchor, context = text_runs(data, bounds)
        ids = batch.column(batch.schema.get_field_index("text_id")).take(pa.array(text))
        columns = [ids, pa.array(first.astype(np.int32)), pa.array(windows.astype(np.int16)), pa.array(before.astype(np.int16))]
        columns += [pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["text_id", "first", "windows", "before", "anchor", "context"])


# --- step 2: contexts of one anchor ------------------------------------------------------

_CONTEXT = "anchor bigint, context bigint, n bigint, windows smallint, before smallint, bytes binary"
_FLAGS = "anchor bigint, context bigint, flags binary"


def _cut_contexts(batches):
    """The bytes of the wanted contexts of each text."""
    for batch in T.slices(batches):
        data, bounds = T.raw(T.column(batch, "text"))
        wanted = batch.column(batch.schema.get_field_index("wanted"))
        w = wanted.flatten()
        text = T.owners(np.asarray(wanted.offsets).astype(np.int64) - wanted.offsets[0].as_py())
        first, windows = np.asarray(w.field("first")), np.asarray(w.field("windows"))
        start = (bounds[text] + first).tolist()
        end = (bounds[text] + first + windows - 1 + LENGTH).tolist()
        raw = data.tobytes()
        cut = pa.array([raw[a:b] for a, b in zip(start, end, strict=True)], pa.binary())
        columns = [w.field(c) for c in ("anchor", "context", "n", "windows", "before")] + [cut]
        yield pa.RecordBatch.from_arrays(columns, ["anchor", "context", "n", "windows", "before", "bytes"])


def _sorted_sides(group: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings (the rows of a matrix, zero beyond their sizes) within their groups, and
    how many bytes each shares with the one before it in that order; -1 in another group."""
    m, width = rows.shape
    columns = -(-width // _SYMBOL)
    padded = np.zeros((m, columns * _SYMBOL), np.uint8)
    padded[:, :width] = rows
    chunks = np.unique(padded.reshape(-1).view(f"V{_SYMBOL}"), return_inverse=True)[1].reshape(m, columns)
    # One text: for each string its group, its symbols and an end that is smaller than all.
    used = -(-sizes // _SYMBOL)
    string = np.zeros((m, columns + 2), np.int64)
    string[:, 0] = group + 1
    string[:, 1:-1] = chunks + m + 2
    keep = np.ones((m, columns + 2), bool)
    keep[:, 1:-1] = np.arange(columns) < used[:, None]
    starts = np.cumsum(keep.sum(axis=1)) - keep.sum(axis=1)
    places = np.full(int(keep.sum()), -1, np.int64)
    places[starts] = np.arange(m)
    order = places[suffix_array(string[keep])]
    order = order[order >= 0]
    a, b = order[:-1], order[1:]
    differ = (rows[a] != rows[b]) | (np.arange(width) >= np.minimum(sizes[a], sizes[b])[:, None])
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    shared[group[a] != group[b]] = -1
    return order, np.concatenate([[-1], shared])


def repeated_windows(blobs: list[bytes], times: np.ndarray, windows: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For each context and each of its windows, whether the window occurs more than once.

    A context is its bytes, how often it occurs, how many windows it has, and the bytes from its
    first window to the anchor. All contexts of an anchor must be given together."""
    m, most = len(blobs), LENGTH - ANCHOR
    sizes = np.fromiter(map(len, blobs), np.int64, m)
    flat = np.frombuffer(b"".join(blobs), np.uint8)
    begin = np.cumsum(sizes) - sizes
    span = np.arange(most)
    anchor = flat[(begin + before)[:, None] + np.arange(ANCHOR)]
    group = np.unique(np.ascontiguousarray(anchor).view(f"V{ANCHOR}").reshape(-1), return_inverse=True)[1]

    def side(length, at):
        inside = span < length[:, None]
        return np.where(inside, flat[np.where(inside, at, 0)], 0).astype(np.uint8)

    after = sizes - before - ANCHOR
    right = _sorted_sides(group, side(after, (begin + before + ANCHOR)[:, None] + span), after)
    left = _sorted_sides(group, side(before, (begin + before - 1)[:, None] - span), before)
    out = np.zeros((m, most + 1), bool)
    stretch = np.zeros((2, m), np.int64)
    for offset in range(most + 1):  # bytes of the window before the anchor
        for k, (order, shared), need in ((0, right, most - offset), (1, left, offset)):
            stretch[k, order] = np.cumsum(shared < need)
        own = np.flatnonzero((offset <= before) & (offset > before - windows))
        if not len(own):
            continue
        _, back = np.unique(stretch[0, own] * (m + 1) + stretch[1, own], return_inverse=True)
        total = np.bincount(back, weights=times[own])[back]
        out[own, before[own] - offset] = total > 1
    return out


def _sorted_contexts(batches):
    """Flags of the windows of each context; rows come sorted by anchor."""
    held: list[pa.RecordBatch] = []

    def flags(rows: pa.Table):
        if not rows.num_rows:
            return
        times, windows, before = (rows.column(c).to_numpy().astype(np.int64) for c in ("n", "windows", "before"))
        found = repeated_windows(rows.column("bytes").to_pylist(), times, windows, before)
        packed = np.packbits(found, axis=1)
        out = [rows.column(c).combine_chunks() for c in ("anchor", "context")]
        yield pa.RecordBatch.from_arrays([*out, pa.array([r.tobytes() for r in packed], pa.binary())], ["anchor", "context", "flags"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BATCH:
            rows = pa.Table.from_batches(held)
            anchor = rows.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))
            if cut:
                yield from flags(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
    if held:
        yield from flags(pa.Table.from_batches(held))


def _single_windows(batches):
    for batch in T.slices(batches):
        at, window, digest = [], [], []
        for k, (blob, n) in enumerate(zip(batch.column(5).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            for i in range(n):
                at.append(k)
                window.append(i)
                digest.append(hashlib.sha256(blob[i : i + LENGTH]).digest())
        rows = batch.select([0, 1, 2]).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(window, pa.int32()), pa.array(digest, pa.binary())], ["anchor", "context", "n", "window", "digest"])


def _hot_flags(contexts: DataFrame) -> DataFrame:
    """The same flags, by counting windows one by one."""
    single = contexts.mapInArrow(_single_windows, "anchor bigint, context bigint, n bigint, window int, digest binary")
    single = written(single, "suffix-windows")
    twice = single.groupBy(F.col("digest").alias("d")).agg(F.sum("n").alias("times")).where("times > 1").select("d")
    found = single.join(twice, F.col("digest") == F.col("d")).groupBy("anchor", "context").agg(F.collect_list("window").alias("at"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(LENGTH - ANCHOR + 8)), lambda i: F.when(F.array_contains("at", i), "1").otherwise("0"))

    def byte(k):
        part = F.array_join(F.slice(bits, 8 * k + 1, 8), "")
        return F.lpad(F.conv(part, 2, 16), 2, "0")

    size = (LENGTH - ANCHOR + 8) // 8
    return found.select("anchor", "context", F.unhex(F.concat(*[byte(k) for k in range(size)])).alias("flags"))


# --- step 3: removal ---------------------------------------------------------------------


def kept_bytes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes stay when the windows at ``starts`` go; and the starts of the removed spans."""
    step = np.zeros(len(data) + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + LENGTH, -1)
    gone = np.cumsum(step[:-1]) > 0
    return ~gone, np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1]]))


def _removed(keep_text: bool):
    def run(batches):
        for batch in T.slices(batches):
            data, bounds = T.raw(T.column(batch, "text"))
            hits = batch.column(batch.schema.get_field_index("hits"))
            removed, spans, digests, rest = [], [], [], []
            for k in range(batch.num_rows):
                own = data[bounds[k] : bounds[k + 1]]
                stay = np.ones(len(own), bool)
                edges = ()
                if hits[k].is_valid:
                    h = hits[k].values
                    first, windows = np.asarray(h.field("first")).astype(np.int64), np.asarray(h.field("windows")).astype(np.int64)
                    starts = []
                    for a, n, f in zip(first.tolist(), windows.tolist(), h.field("flags").to_pylist(), strict=True):
                        marks = np.arange(n) if f is None else np.flatnonzero(np.unpackbits(np.frombuffer(f, np.uint8))[:n])
                        starts.append(a + marks)
                    stay, edges = kept_bytes(own, np.concatenate(starts))
                left = own[stay].tobytes()
                removed.append(len(own) - len(left))
                spans.append(len(edges))
                digests.append(hashlib.sha256(left).hexdigest())
                rest.append(left)
            columns = [batch.column(0), pa.array(np.diff(bounds)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns, names = [*columns, pa.array(rest, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def drop_repeats(docs: DataFrame, id_column: str = "doc_id", keep_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), the
    last the bytes that are left; they may be cut inside a character."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col(id_column).alias("doc_id"), text.alias("text")).withColumn("text_id", F.xxhash64("text", F.octet_length("text")))
    runs = written(texts.select("text_id", "text").mapInArrow(_emitted_runs, _RUN), "suffix-runs")
    # Contexts by anchor: how many there are and how often they occur.
    contexts = runs.groupBy("anchor", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("text_id", "first")).alias("at"), F.first("windows").alias("windows"), F.first("before").alias("before")
    )
    kinds = contexts.groupBy(F.col("anchor").alias("k_anchor")).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all")).where("all > 1")
    contexts = contexts.join(kinds, F.col("anchor") == F.col("k_anchor")).drop("k_anchor", "all")
    contexts = written(contexts, "suffix-contexts")
    # A context of its own anchor alone, seen twice: every window repeats.
    plain = contexts.where("kinds = 1").select("anchor", "context", F.lit(None).cast("binary").alias("flags"))
    wanted = contexts.where("kinds > 1").select(F.col("at.text_id").alias("w_id"), F.struct("at.first", "windows", "before", "anchor", "context", "n", "kinds").alias("w"))
    wanted = wanted.groupBy("w_id").agg(F.collect_list("w").alias("wanted"))  # of one text
    cut = texts.select("text_id", "text").join(wanted, F.col("text_id") == F.col("w_id")).select("text", "wanted")
    cut = cut.mapInArrow(_cut_contexts, _CONTEXT).groupBy("anchor", "context").agg(*[F.first(c).alias(c) for c in ("n", "windows", "before", "bytes")])
    cut = written(cut, "suffix-bytes")
    hot = contexts.where(F.col("kinds") > HOT).select(F.col("anchor").alias("h_anchor")).distinct()
    hot = written(hot, "suffix-hot")
    cold = cut.join(hot, F.col("anchor") == F.col("h_anchor"), "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    flags = cold.select("anchor", "context", "n", "windows", "before", "bytes").mapInArrow(_sorted_contexts, _FLAGS)
    flags = flags.unionByName(plain)
    if not hot.isEmpty():
        flags = flags.unionByName(_hot_flags(cut.join(hot, F.col("anchor") == F.col("h_anchor"), "left_semi")))
    flags = written(flags, "suffix-flags").withColumnsRenamed({"anchor": "f_anchor", "context": "f_context"})
    hits = runs.join(flags, (F.col("anchor") == F.col("f_anchor")) & (F.col("context") == F.col("f_context")))
    hits = hits.select("text_id", "first", "windows", "flags").distinct()
    hits = hits.groupBy(F.col("text_id").alias("t_id")).agg(F.collect_list(F.struct("first", "windows", "flags")).alias("hits"))  # of one text
    found = texts.join(hits, F.col("text_id") == F.col("t_id"), "left").select("doc_id", "text", "hits")
    form = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return found.mapInArrow(_removed(keep_text), form + (", kept binary" if keep_text else ""))


@query("op1_lyndon_groups")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings that occur elsewhere."""
    return drop_repeats(table(spark, sf_dir, "documents"), keep_text=False)
