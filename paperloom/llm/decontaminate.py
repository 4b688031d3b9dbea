"""Benchmark decontamination: rare word sequences find passages, alignment scores them.

Words are runs between white space, in lower case and without punctuation at their ends. A seed
is a sequence of three neighbouring words of a test item. It is rare if the product of its words'
shares of the corpus is ``RARE`` or less; the shares are counted over all texts, so a passage
that was copied often does not make its own seeds common. An item of common words alone keeps its
``LEAST_SEEDS`` rarest ones. Wherever a text holds a seed, the words around it are aligned with
the item by Smith-Waterman (match +2, mismatch and gap -1); the score is the best alignment's
share of the item's own score, and ``THRESHOLD`` or more counts as a copy, edited or not.

The items are a stated query set: they are taken in blocks of ``BLOCK_WORDS`` words, each sent
to all tasks, and every text is scanned against every block. No text leaves its row, so a passage
in a third of all rows costs no task more than its share.

Nulls: a null text or item is empty; empty texts are clean, and items of fewer than three words
match nothing. Null ids are carried. Repeated rows give repeated results, repeated items are
matched each. Empty tables give empty results. Other columns are carried or ignored.
"""

from __future__ import annotations

import string
import uuid
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from paperloom.llm import texts as T
from paperloom.llm.store import query, table

SEED_WORDS = 3
RARE = 1e-8
LEAST_SEEDS = 4
THRESHOLD = 0.5
BLOCK_WORDS = 1 << 19
PUNCTUATION = string.punctuation + "«»¿¡“”‘’„–—…"

MATCHES = "array<struct<item_id:{0},score:double,first_word:bigint,last_word:bigint>>"


def item_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Plain words of each text, and each text's bounds in them."""
    flat, bounds = T.words(texts)
    distinct, codes = T.coded(flat)
    plain = pc.utf8_trim(pc.utf8_lower(distinct), characters=PUNCTUATION)
    keep = np.asarray(pc.greater(pc.binary_length(plain), 0)).astype(bool)[codes] if len(codes) else np.zeros(0, bool)
    return plain.take(pa.array(codes[keep])), np.concatenate([[0], np.cumsum(keep)])[bounds]


def known_words(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the texts' plain words in ``vocabulary`` (-1: elsewhere), and the texts' bounds."""
    flat, bounds = T.words(texts)
    distinct, codes = T.coded(flat)
    plain = pc.utf8_trim(pc.utf8_lower(distinct), characters=PUNCTUATION)
    place = np.asarray(pc.index_in(plain, vocabulary).fill_null(-1)).astype(np.int64)
    place[np.asarray(pc.equal(pc.binary_length(plain), 0)).astype(bool)] = -2
    codes = place[codes] if len(codes) else codes
    keep = codes != -2
    return codes[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


# --- items -------------------------------------------------------------------------------


def _blocks(items: DataFrame) -> list[DataFrame]:
    """The items in blocks of bounded size."""
    words = F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))
    total = items.agg(F.sum(words)).first()[0] or 0
    parts = max(1, -(-total // BLOCK_WORDS))
    part = F.pmod(F.xxhash64("text", "item_id"), F.lit(parts))
    return [items.where(part == k).orderBy("item_id", "text") for k in range(parts)]


def read_items(block: pa.Table) -> SimpleNamespace:
    """A block's ids, vocabulary and word sequences."""
    flat, bounds = item_words(block.column("text").combine_chunks().cast(pa.string()).fill_null(""))
    vocabulary, codes = T.coded(flat)
    return SimpleNamespace(ids=block.column("item_id").combine_chunks(), vocabulary=vocabulary, codes=codes, bounds=bounds)


def add_seeds(items: SimpleNamespace, share: np.ndarray) -> SimpleNamespace:
    """With the sorted keys of the rare seeds, and the item and place of each."""
    codes, bounds = items.codes, items.bounds
    n = len(codes) - SEED_WORDS + 1
    own = T.owners(bounds)
    at = np.flatnonzero(own[:n] == own[SEED_WORDS - 1 :]) if n > 0 else np.zeros(0, np.int64)
    odds = np.ones(len(at))
    for k in range(SEED_WORDS):
        odds *= share[codes[at + k]]
    order = np.lexsort((odds, own[at]))
    rank = np.empty(len(at), np.int64)
    rank[order] = np.arange(len(at)) - np.searchsorted(own[at][order], own[at][order])
    at = at[(odds <= RARE) | (rank < LEAST_SEEDS)]
    keys = seed_keys(codes, at)
    order = np.argsort(keys, kind="stable")
    at = at[order]
    return SimpleNamespace(**vars(items), seed_keys=keys[order], seed_item=own[at], seed_at=at - bounds[own[at]])


def seed_keys(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number for the known words at ``at`` and after; a block has under 2 ** 21 of them."""
    out = np.zeros(len(at), np.int64)
    for k in range(SEED_WORDS):
        out = out * (1 << 21) + codes[at + k]
    return out


def _counted(items):
    def run(batches):
        vocabulary = items.value.vocabulary
        counts, total = np.zeros(len(vocabulary), np.int64), 0
        for batch in T.slices(batches):
            codes, _ = known_words(T.column(batch, "text"), vocabulary)
            counts += np.bincount(codes[codes >= 0], minlength=len(counts))
            total += len(codes)
        place = np.concatenate([np.flatnonzero(counts), [-1]])
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.concatenate([counts[counts > 0], [total]]))], ["word", "n"])

    return run


# --- alignment ---------------------------------------------------------------------------


def align(passages: np.ndarray, items: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman scores of each row of ``passages`` (padded with -1) with its row of
    ``items`` (padded with -3), and the first and last word of the best alignment."""
    n, width = passages.shape
    ramp = np.arange(width + 1)
    above, above_from = np.zeros((n, width + 1), np.int32), np.tile(ramp, (n, 1))
    best, first, last = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(int(lengths.max(initial=0))):
        hit = np.where(passages == items[:, i : i + 1], 2, -1)
        now, now_from = above - 1, above_from.copy()
        diagonal = above[:, :-1] + hit
        better = diagonal >= now[:, 1:]
        now[:, 1:][better] = diagonal[better]
        now_from[:, 1:][better] = above_from[:, :-1][better]
        # Gaps in the item's direction: the best of all cells to the left, less their distance.
        reach = now + ramp
        run = np.maximum.accumulate(reach, axis=1)
        source = np.maximum.accumulate(np.where(reach == run, ramp, 0), axis=1)
        now = run - ramp
        now_from = np.take_along_axis(now_from, source, axis=1)
        fresh = now <= 0
        now[fresh] = 0
        now_from[fresh] = np.broadcast_to(ramp, now.shape)[fresh]
        live = i < lengths
        top = now.argmax(axis=1)
        score = now[np.arange(n), top]
        gain = live & (score > best)
        best[gain], last[gain], first[gain] = score[gain], top[gain] - 1, now_from[np.arange(n), top][gain]
        above, above_from = now, now_from
    return best, first, last


def copies(codes: np.ndarray, bounds: np.ndarray, items: SimpleNamespace, threshold: float = THRESHOLD) -> list[np.ndarray]:
    """(text, item, score, first word, last word) of every item that a text holds a copy of."""
    own = T.owners(bounds)
    n = len(codes) - SEED_WORDS + 1
    empty = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    if n <= 0 or not len(items.seed_keys):
        return empty
    good = own[:n] == own[SEED_WORDS - 1 :]
    for k in range(SEED_WORDS):
        good &= codes[k : n + k] >= 0
    at = np.flatnonzero(good)
    keys = seed_keys(codes, at)
    lo, hi = np.searchsorted(items.seed_keys, keys), np.searchsorted(items.seed_keys, keys, side="right")
    times = hi - lo
    at = np.repeat(at, times)
    if not len(at):
        return empty
    seed = np.repeat(lo, times) + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    item, text = items.seed_item[seed], own[at]
    size = np.diff(items.bounds)[item]
    margin = size // 2 + 4
    begin = at - items.seed_at[seed]
    # Hits of one item whose beginnings fall in one stretch share a window.
    tile = begin // margin
    pick = np.unique(np.stack([text, item, tile], 1), axis=0, return_index=True)[1]
    text, item, size, margin, tile = text[pick], item[pick], size[pick], margin[pick], tile[pick]
    left = np.maximum(tile * margin - margin, bounds[text])
    right = np.minimum(tile * margin + 2 * margin + size, bounds[text + 1])
    found = []
    order = np.argsort(size, kind="stable")
    step = 0
    while step < len(order):
        some = order[step : step + max(1, (1 << 20) // int(3 * size[order[min(step + 4095, len(order) - 1)]] + 16))][:4096]
        step += len(some)
        span = np.arange(int((right - left)[some].max()))
        cells = left[some][:, None] + span
        passages = np.where(cells < right[some][:, None], codes[np.minimum(cells, len(codes) - 1)], -1)
        span = np.arange(int(size[some].max()))
        cells = items.bounds[item[some]][:, None] + span
        wanted = np.where(span < size[some][:, None], items.codes[np.minimum(cells, len(items.codes) - 1)], -3)
        score, first, last = align(passages, wanted, size[some])
        share = score / (2.0 * size[some])
        ok = share >= threshold
        start = left[some][ok] - bounds[text[some][ok]]
        found.append([text[some][ok], item[some][ok], share[ok], start + first[ok], start + last[ok]])
    text, item, share, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((last, first, -share, item, text))
    text, item, share, first, last = (x[order] for x in (text, item, share, first, last))
    top = np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])]) if len(text) else np.zeros(0, bool)
    return [x[top] for x in (text, item, share, first, last)]


def _matched(items, threshold, keep_text, column):
    def run(batches):
        block = items.value
        for batch in T.slices(batches):
            codes, bounds = known_words(T.column(batch, "text"), block.vocabulary)
            text, item, share, first, last = copies(codes, bounds, block, threshold)
            rows = pa.StructArray.from_arrays(
                [block.ids.take(pa.array(item)), pa.array(share), pa.array(first), pa.array(last)], ["item_id", "score", "first_word", "last_word"]
            )
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)), pa.int32()), rows)
            rest = [i for i, n in enumerate(batch.schema.names) if keep_text or n != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in rest] + [lists], [batch.schema.names[i] for i in rest] + [column])

    return run


def with_matches(docs: DataFrame, items: DataFrame, column: str = "matches", threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """``docs`` with the copied items of each text: (item_id, score, first_word, last_word),
    words counted from the text's start. ``docs`` has a column ``text``, ``items`` has
    ``item_id`` and ``text``."""
    context = docs.sparkSession.sparkContext
    items = items.select("item_id", F.col("text").cast("string"))
    kind = StructType.fromDDL("m " + MATCHES.format(items.schema["item_id"].dataType.simpleString())).fields[0].dataType
    texts = docs.select(F.col("text").cast("string"))
    out, blocks = docs, _blocks(items)
    names = [f"{column}_{k}_{uuid.uuid4().hex[:8]}" for k in range(len(blocks))]
    for name, rows in zip(names, blocks, strict=True):
        block = read_items(rows.toArrow())
        counts = texts.mapInArrow(_counted(context.broadcast(block)), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
        share = np.zeros(len(block.vocabulary) + 1)
        for word, n in counts.collect():  # one row per word of the block
            share[word] = n
        block = add_seeds(block, share[:-1] / max(share[-1], 1.0))
        keep = keep_text or name != names[-1]
        schema = StructType([f for f in out.schema.fields if keep or f.name != "text"]).add(StructField(name, kind))
        out = out.mapInArrow(_matched(context.broadcast(block), threshold, keep, name), schema)
    return out.select("*", F.concat(*names).alias(column)).drop(*names)


def without_matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no copy of an item, with all their columns."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    return with_matches(rows, items, keep_text=False).where(F.size("matches") == 0).select("row.*")


@query("op6_rare_seeds")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a copy of a test item: the pair, the alignment's score and place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_matches(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
