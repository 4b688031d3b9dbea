"""Sharding by histogram sort: exact splitters first, one exchange after.

Every row gets a key, 32 hexadecimal digits hashed from its id and text. To cut the key order into
shards of near-equal bytes, each round counts the exact bytes below candidate boundaries: the
first round those of the first two digits, each later one two digits more, and only inside the
intervals in which a splitter still lies. A splitter is done when a boundary is within
``tolerance`` bytes of its target, or when its interval holds one key; then it is the boundary
next to the target. A round sends at most 256 sums for each splitter to the driver. When all
splitters are known, the rows are exchanged once, sorted by shard and key; a row's slot is its
place in its partition plus the counts of the partitions before.

Nulls: a null text has no bytes (size 1) and the checksum of the empty text, a null id is kept.
Rows alike in id and text share a key: the exchange tells them apart by their input place, so
they spread over tasks, but they stay in one shard. An empty table gives an empty result. All
columns are carried in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.store import few, query, table, written

SHARDS = 8
TOLERANCE = 0
DIGITS = 32
STEP = 2


def n_bytes(text: str = "text") -> Column:
    """Bytes of the text and one for its end."""
    return F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long") + 1


def row_key(id_column: str = "doc_id", text: str = "text") -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(F.col(id_column).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))))


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[str]:
    """The smallest key, or a prefix of it, of every shard but the first. ``keys``: (key, size)."""
    total = keys.agg(F.sum("size")).first()[0]
    if total is None:
        return [""] * (shards - 1)
    targets = [total * k / shards for k in range(1, shards)]
    open_at = {k: ("", 0) for k in range(len(targets))}  # splitter: prefix and the bytes before it
    found: dict[int, str] = {}
    digits = 0
    while open_at:
        prefixes = sorted({p for p, _ in open_at.values()})
        inside = keys.where(F.substring("key", 1, digits).isin(prefixes)) if digits else keys
        digits += STEP
        sums = inside.groupBy(F.substring("key", 1, digits).alias("bin")).agg(F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high"))
        bins = sorted(tuple(r) for r in sums.collect())  # at most 256 for each open splitter
        for k, (prefix, below) in list(open_at.items()):
            for name, size, low, high in bins:
                if not name.startswith(prefix):
                    continue
                if targets[k] > below + size:
                    below += size
                    continue
                near, far = targets[k] - below, below + size - targets[k]
                if min(near, far) <= tolerance or low == high:
                    # "g" follows every digit: the boundary behind the bin.
                    found[k] = name if near < far else name + "g" if low != high else low + "g"
                    del open_at[k]
                else:
                    open_at[k] = (name, below)
                break
    return [found[k] for k in range(len(targets))]


def shard_rows(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, id_column: str = "doc_id") -> DataFrame:
    """(row, key, size, shard, slot): every row of ``docs`` with its place."""
    rows = docs.select(F.struct("*").alias("row"), row_key(id_column).alias("key"), n_bytes().alias("size"))
    cuts = splitters(written(rows.select("key", "size"), "shard-keys"), shards, tolerance)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("key") >= cut).cast("int")
    rows = rows.withColumn("shard", shard).withColumn("tie", F.monotonically_increasing_id())
    placed = rows.repartitionByRange("shard", "key", "tie").sortWithinPartitions("shard", "key", "tie").drop("tie")
    placed = written(placed.withColumn("place", F.monotonically_increasing_id()), "shards")
    # The upper bits of the place are the partition, the lower ones the row's number in it.
    part = F.shiftright("place", 33)
    counts = placed.groupBy("shard", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")
    counts = few(counts.select(F.col("shard").alias("c_shard"), F.col("part").alias("c_part"), offset.alias("offset")), "shard-counts")
    placed = placed.join(counts, (F.col("shard") == F.col("c_shard")) & (part == F.col("c_part")))
    return placed.select("row", "key", "size", "shard", (F.col("place") + F.col("offset")).alias("slot"))


@query("op4_histogram_sort")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot, shards of near-equal bytes."""
    text = F.coalesce(F.col("row.text"), F.lit("")).cast("binary")
    return shard_rows(table(spark, sf_dir, "documents")).select(
        "row.doc_id", "size", F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
