"""Near duplicates by SimHash, found by covering locality-sensitive hashing.

A text's fingerprint has 64 bits: bit i is set if it is set in more than half of the XXH64 hashes
of the text's word shingles. Fingerprints link at ``radius`` or fewer differing bits. To find the
links, each bit gets one of the nonzero vectors of ``radius + 1`` bits; each of the
``2 ** (radius + 1) - 1`` nonzero vectors v makes a table whose mask holds the bits with an odd
product with v. Any ``radius`` bits leave at least one v with even products for all of them, so
a pair within the radius agrees under that mask: no link can be missed.

Only distinct fingerprints enter the tables. Buckets of more than ``BUCKET`` fingerprints are cut
by the same construction over the bits that their mask leaves free, again and again: the free
bits halve each time, so a bucket of distinct fingerprints has ``BUCKET`` or 128 of them in the
end whatever the data, and the guarantee holds within it. Within a bucket, links are checked exactly and given as a forest.

Nulls: a null text has no words (fingerprint zero, linked like any other); a null id is kept and
never becomes a component's id unless all ids of the component are null. Repeated rows give
repeated results. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import texts as T
from paperloom.llm.components import components
from paperloom.llm.store import query, table, written

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
BUCKET = 32
#: Under so many free bits a mask may not grow, and a bucket has 128 fingerprints at most.
LEAST_FREE = 8


# --- fingerprints ------------------------------------------------------------------------


def shingle_hashes(texts: pa.Array, size: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle, and each text's bounds in them."""
    flat, bounds = T.words(pc.ascii_lower(texts))
    counts = np.diff(bounds)
    n = len(flat)
    whole = T.owners(bounds)
    starts = np.flatnonzero(whole[: n - size + 1] == whole[size - 1 :]) if n >= size else np.zeros(0, np.int64)
    at = pa.array(starts)
    parts = [flat.take(pc.add(at, k)) for k in range(size)]
    long = pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, long.cast(pa.binary()).to_pylist(), repeat(seed)), np.uint64, len(long))
    own = whole[starts]
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        short = [" ".join(flat.slice(bounds[i], counts[i]).to_pylist()).encode() for i in few]
        hashes = np.concatenate([hashes, np.fromiter(map(xxhash.xxh64_intdigest, short, repeat(seed)), np.uint64, len(short))])
        own = np.concatenate([own, few])
        order = np.argsort(own, kind="stable")
        hashes, own = hashes[order], own[order]
    return hashes, np.searchsorted(own, np.arange(len(counts) + 1))


def majority(hashes: np.ndarray, bounds: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Fingerprints: the bits set in over half of each text's hashes."""
    counts = np.zeros((len(bounds) - 1, BITS), np.int64)
    own = T.owners(bounds)
    for a in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[a : a + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        texts, first = np.unique(own[a : a + step], return_index=True)
        counts[texts] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    set_bits = 2 * counts > np.diff(bounds)[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def _printed(shingle: int):
    def run(batches):
        for batch in T.slices(batches, 1 << 20):
            prints = majority(*shingle_hashes(T.column(batch, "text"), shingle))
            rest = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in rest] + [pa.array(prints.view(np.int64))], [batch.schema.names[i] for i in rest] + ["fp"])

    return run


def fingerprints(docs: DataFrame, id_column: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col("text").cast("string"))
    return docs.mapInArrow(_printed(shingle), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


# --- covering tables ---------------------------------------------------------------------


def covering_masks(held: int, radius: int = RADIUS) -> list[int]:
    """Masks that contain ``held`` and cover every choice of ``radius`` bits outside it."""
    free = [i for i in range(BITS) if not held >> i & 1]
    vectors = (1 << radius + 1) - 1
    return sorted({held | sum(1 << i for r, i in enumerate(free) if ((r % vectors + 1) & v).bit_count() % 2) for v in range(1, vectors + 1)})


def _dealt(radius: int):
    def run(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            masks = np.asarray(batch.column(0)).view(np.uint64)
            prints = np.asarray(batch.column(1)).view(np.uint64)
            for held in np.unique(masks).tolist():
                if held not in known:
                    known[held] = np.array(covering_masks(held, radius), np.uint64)
                own, new = prints[masks == held], known[held]
                for mask in new:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), mask).view(np.int64)), pa.array((own & mask).view(np.int64)), pa.array(own.view(np.int64))], ["mask", "key", "fp"]
                    )

    return run


def _forests(radius: int):
    """Links of each bucket that join the same fingerprints as all its links do."""

    def links(mask, key, fp):
        n = len(fp)
        same = np.concatenate([[0], np.cumsum((mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))])
        left, right = [], []
        for d in range(1, n):
            near = same[d:] == same[:-d]
            if not near.any():
                break
            at = np.flatnonzero(near & (np.bitwise_count(fp[d:] ^ fp[:-d]) <= radius))
            left.append(at)
            right.append(at + d)
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        left, right = np.concatenate(left), np.concatenate(right)
        root = np.arange(n)
        while True:
            new = root.copy()
            least = np.minimum(root[left], root[right])
            np.minimum.at(new, left, least)
            np.minimum.at(new, right, least)
            if (new == root).all():
                break
            root = new
        at = np.flatnonzero(root != np.arange(n))
        return at, root[at]

    def run(batches):
        held = None
        for batch in batches:
            now = [np.asarray(c).view(np.uint64) for c in batch.columns]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            mask, key, fp = now
            cut = len(fp)
            while cut and mask[cut - 1] == mask[-1] and key[cut - 1] == key[-1]:
                cut -= 1
            held = [x[cut:] for x in now]
            yield from emitted(mask[:cut], key[:cut], fp[:cut])
        if held is not None:
            yield from emitted(*held)

    def emitted(mask, key, fp):
        a, b = links(mask, key, fp) if len(fp) > 1 else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], ["u", "v"])

    return run


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links that join exactly the distinct fingerprints ``fp`` within ``radius`` bits
    of one another, directly or over others."""
    # Spark marks a bucket by its mask and the bits under it; all of ``fp`` starts in one of mask 0.
    open_rows = prints.select(F.lit(0).cast("long").alias("mask"), "fp")
    found = None
    while True:
        rows = written(open_rows.mapInArrow(_dealt(radius), "mask bigint, key bigint, fp bigint"), "simhash-tables")
        sizes = rows.groupBy(F.col("mask").alias("s_mask"), F.col("key").alias("s_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = rows.join(sizes, (F.col("mask") == F.col("s_mask")) & (F.col("key") == F.col("s_key"))).select("mask", "key", "fp", "n")
        sized = written(sized, "simhash-buckets")
        whole = (F.col("n") <= BUCKET) | (F.bit_count("mask") > BITS - LEAST_FREE)
        few = sized.where(whole).repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").select("mask", "key", "fp")
        new = few.mapInArrow(_forests(radius), "u bigint, v bigint")
        found = new if found is None else found.unionByName(new)
        open_rows = sized.where(~whole).select("mask", "fp").distinct()
        if open_rows.isEmpty():
            return found


# --- the operator ------------------------------------------------------------------------


def near_groups(docs: DataFrame, id_column: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: (doc_id, fp, component_id), the last the smallest id among
    all texts that can be reached over links."""
    prints = written(fingerprints(docs, id_column, shingle), "simhash")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(near_links(distinct.select("fp"), radius))
    placed = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = written(placed, "simhash-roots")
    least = placed.groupBy(F.col("root").alias("c_root")).agg(F.min("least").alias("component_id"))
    classes = placed.join(least, F.col("root") == F.col("c_root")).select(F.col("fp").alias("c_fp"), "component_id")
    return prints.join(classes, F.col("fp") == F.col("c_fp")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the one of the smallest id (nulls last).

    Texts without words (null, empty or white space) have fingerprint zero and are one component
    like any other, so one row of them stays. Of repeated rows one stays. An empty table gives an
    empty result, and all columns are carried.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"))
    rows = written(rows.select("row", "id", F.monotonically_increasing_id().alias("place")), "simhash-rows")
    groups = near_groups(rows.select("place", "row.text"), "place").select(F.col("doc_id").alias("place"), "component_id")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "place"))
    kept = rows.select("place", "id").join(groups, "place").groupBy("component_id").agg(first.alias("first"))
    return rows.join(kept.select(F.col("first.place").alias("place")), "place", "left_semi").select("row.*")


@query("op3_simhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest id of its near-duplicate component."""
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
