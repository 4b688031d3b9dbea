"""Hard negatives by vertical scans with bounds over columnar dimensions (BOND).

A row's score for an anchor is their inner product. An anchor's positives are its best other rows
of the same label; a positive's negatives are the best rows of other labels whose score lies in
the window from ``share`` percent of the positive's score up to that score.

Rows are sorted by label and scanned as blocks of one label, turned into one array per dimension.
For each anchor a block's dimensions are read in the descending magnitude of the anchor's own
components, ``STEP`` at a time. What the dimensions still unread can add at least and at most,
from the block's minimum and maximum of each, bounds every row's score; a row stays in the
candidate bitmap only while its bounds still meet one of the anchor's windows. A window narrows
as rows are resolved: only what beats its worst kept row counts. Most blocks are passed over
before any dimension is read, by the bounds of the whole block.

Anchors go to the tasks in blocks of ``NUMBERS`` components at most, one after the other, while
the rows stay where they are: no pair is emitted, and a task returns ``positives`` rows an anchor in the
first scan and ``negatives`` rows a window in the second.

Components are doubles; scores are exact as long as they stay under 2^53. A shorter vector has
zeros for the components that it lacks. Nulls: rows with a null id, label or vector or with a null
or non-finite component take no part. Ties go to the smaller id. Repeated rows are rows of their
own: each is an anchor, and a row's twin can be its positive. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.store import query, table, written
from paperloom.operators.relational import numbered

POSITIVES = 5
NEGATIVES = 5
SHARE = 80
NUMBERS = 1 << 21  # components of a block of anchors
BLOCK = 8192  # rows that are scanned together
STEP = 8  # dimensions between two looks at the bounds

Keep = Callable[[np.ndarray, np.ndarray], np.ndarray]


# --- blocks ------------------------------------------------------------------------------


class Block:
    """Rows of one label, one contiguous array per dimension."""

    def __init__(self, label: int, ids: np.ndarray, places: np.ndarray, rows: np.ndarray):
        self.label, self.ids, self.places = label, ids, places
        self.dims = np.ascontiguousarray(rows.T)
        self.low, self.high = self.dims.min(axis=1), self.dims.max(axis=1)

    def reach(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score that a row here can have, for each anchor."""
        anchors = _as_wide(anchors, len(self.dims))
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ self.low + down @ self.high, up @ self.high + down @ self.low

    def scan(self, anchor: np.ndarray, keep: Keep) -> tuple[np.ndarray, np.ndarray]:
        """Places in the block and exact scores of the rows whose bounds ``keep`` never refuses."""
        anchor = _as_wide(anchor[None, :], len(self.dims))[0]
        order = np.argsort(-np.abs(anchor), kind="stable")
        least = np.minimum(anchor * self.low, anchor * self.high)[order]
        most = np.maximum(anchor * self.low, anchor * self.high)[order]
        rest_low, rest_high = (np.concatenate([np.cumsum(x[::-1])[::-1], [0.0]]) for x in (least, most))
        live, score = None, np.zeros(len(self.ids))
        for a in range(0, len(order), STEP):
            some = order[a : a + STEP]
            read = self.dims[some] if live is None else self.dims[some][:, live]
            score = score + anchor[some] @ read
            b = min(a + STEP, len(order))
            stays = keep(score + rest_low[b], score + rest_high[b])
            if not stays.all():
                live = np.flatnonzero(stays) if live is None else live[stays]
                score = score[stays]
                if not len(live):
                    break
        return np.arange(len(self.ids)) if live is None else live, score


def _as_wide(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows cut or filled with zeros to ``width`` components."""
    if rows.shape[1] >= width:
        return rows[:, :width]
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of numbers as one matrix, short ones filled with zeros."""
    vectors = pa.concat_arrays([vectors])
    at = np.asarray(vectors.offsets).astype(np.int64)
    flat, sizes = np.asarray(vectors.values).astype(np.float64)[at[0] : at[-1]], np.diff(at)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def blocks(batches) -> Iterator[Block]:
    """Blocks of rows (label, vec_id, place, vector) that come sorted by label."""
    held: list[tuple] = []

    def block():
        width = max(r.shape[1] for *_, r in held)
        ids, places = (np.concatenate([h[k] for h in held]) for k in (1, 2))
        out = Block(held[0][0], ids, places, np.concatenate([_as_wide(r, width) for *_, r in held]))
        held.clear()
        return out

    for batch in batches:
        labels, ids, places = (np.asarray(batch.column(k)) for k in range(3))
        edges = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1], [True]])) if len(labels) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            for c in range(a, b, BLOCK):
                d = min(c + BLOCK, b)
                if held and (held[0][0] != labels[c] or sum(len(h[1]) for h in held) + d - c > BLOCK):
                    yield block()
                held.append((labels[c], ids[c:d], places[c:d], _matrix(batch.column(3).slice(c, d - c))))
    if held:
        yield block()


# --- the two scans -----------------------------------------------------------------------


class Best:
    """The best (score, id, place) so far: larger scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.score = k, np.zeros(0)
        self.ids, self.places = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def floor(self) -> float:
        """Rows below this score come too late."""
        return self.score[-1] if len(self.score) == self.k else -np.inf

    def add(self, score: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        score, ids, places = (np.concatenate(x) for x in ((self.score, score), (self.ids, ids), (self.places, places)))
        order = np.lexsort((places, ids, -score))[: self.k]
        self.score, self.ids, self.places = score[order], ids[order], places[order]


def _beyond(lower: np.ndarray, k: int) -> float:
    """A score that at least ``k`` rows reach, by what their bounds say."""
    return np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) >= k else -np.inf


def _positives(anchors, k: int):
    """For each anchor the best ``k`` other rows of its label, within a task's rows."""

    def run(batches):
        places, labels, vectors = anchors.value
        best: dict[int, Best] = {}
        for block in blocks(batches):
            own = np.flatnonzero(labels == block.label)
            _, most = block.reach(vectors[own])
            for q, reach in zip(own.tolist(), most.tolist(), strict=True):
                found = best.setdefault(q, Best(k))
                if reach < found.floor:
                    continue
                # The anchor itself may be among the rows, hence one more.
                keep = lambda low, high, f=found: high >= max(f.floor, _beyond(low, k + 1))
                at, score = block.scan(vectors[q], keep)
                other = block.places[at] != places[q]
                found.add(score[other], block.ids[at[other]], block.places[at[other]])
        for q, b in best.items():
            n = len(b.score)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, places[q])), pa.array(b.ids), pa.array(b.places), pa.array(b.score)], ["anchor", "positive_id", "positive", "positive_score"]
            )

    return run


def _negatives(anchors, k: int, share: int):
    """For each window the best ``k`` rows of other labels inside it, within a task's rows."""

    def run(batches):
        labels, vectors, windows = anchors.value
        tops = [w[1] for w in windows]  # the positives' scores
        ends = [np.array([w.min() * share / 100, w.max()]) if len(w) else np.array([np.inf, -np.inf]) for w in tops]
        ends = np.array(ends).reshape(-1, 2)
        best = [[Best(k) for _ in w] for w in tops]
        for block in blocks(batches):
            other = labels != block.label
            least, most = block.reach(vectors)
            for q in np.flatnonzero(other & (most >= ends[:, 0]) & (least <= ends[:, 1])).tolist():

                def keep(low, high, q=q):
                    stays = np.zeros(len(low), bool)
                    for top, found in zip(tops[q].tolist(), best[q], strict=True):
                        stays |= (100 * high >= max(share * top, 100 * found.floor)) & (low <= top)
                    return stays

                at, score = block.scan(vectors[q], keep)
                for top, found in zip(tops[q].tolist(), best[q], strict=True):
                    inside = np.flatnonzero((100 * score >= share * top) & (score <= top) & (score >= found.floor))
                    if len(inside):
                        found.add(score[inside], block.ids[at[inside]], block.places[at[inside]])
        for q, some in enumerate(best):
            for window, b in zip(windows[q][0].tolist(), some, strict=True):
                if len(b.score):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(b.score), window)), pa.array(b.ids), pa.array(b.places), pa.array(b.score)],
                        ["window", "negative_id", "negative", "negative_score"],
                    )

    return run


# --- the operator ------------------------------------------------------------------------


def _usable(rows: DataFrame, id_column: str, vector_column: str, label: Column) -> DataFrame:
    vector = F.col(vector_column).cast("array<double>")
    rows = rows.select(label.cast("bigint").alias("label"), F.col(id_column).cast("bigint").alias("vec_id"), vector.alias("vector"))
    fine = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return rows.where("label IS NOT NULL AND vec_id IS NOT NULL AND vector IS NOT NULL").where(fine)


def _parts(anchors: DataFrame, numbers: int) -> Iterator[DataFrame]:
    """The anchors in parts of ``numbers`` components at most."""
    anchors, n = numbered(anchors, "negative-anchors")
    width = anchors.agg(F.max(F.size("vector"))).first()[0]
    most = max(1, numbers // max(1, width or 0))
    for start in range(0, n, most):
        yield anchors.where((F.col("number") >= start) & (F.col("number") < start + most)).drop("number")


def hard_negatives(
    rows: DataFrame, is_anchor: Column, id_column: str = "vec_id", vector_column: str = "vector", label: Column | None = None,
    positives: int = POSITIVES, negatives: int = NEGATIVES, share: int = SHARE, numbers: int = NUMBERS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), scores as doubles;
    ``is_anchor`` is a condition on ``vec_id``."""
    spark = rows.sparkSession
    held = _usable(rows, id_column, vector_column, F.col("label") if label is None else label)
    held = held.repartitionByRange("label", F.xxhash64("vec_id", "vector")).withColumn("place", F.monotonically_increasing_id())
    held = written(held.sortWithinPartitions("label").select("label", "vec_id", "place", "vector"), "negative-rows")
    found = None
    for own in _parts(held.where(is_anchor), numbers):
        sent = own.toArrow()
        labels, ids, places = (sent.column(k).to_numpy() for k in range(3))
        vectors = _matrix(sent.column(3).combine_chunks())
        first = spark.sparkContext.broadcast((places, labels, vectors))
        best = held.mapInArrow(_positives(first, positives), "anchor bigint, positive_id bigint, positive bigint, positive_score double")
        order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive")
        best = best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives)
        # ``window`` numbers this part's windows: an anchor's place in the part and the positive's rank.
        best = written(best, "negative-positives").toArrow()
        at = {p: q for q, p in enumerate(places.tolist())}
        anchor = np.fromiter(map(at.__getitem__, best.column("anchor").to_pylist()), np.int64, best.num_rows)
        window = anchor * positives + best.column("n").to_numpy() - 1
        tops = best.column("positive_score").to_numpy()
        order = np.argsort(window, kind="stable")
        cuts = np.searchsorted(anchor[order], np.arange(len(places) + 1))
        windows = [(window[order[a:b]], tops[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        second = spark.sparkContext.broadcast((labels, vectors, windows))
        new = held.mapInArrow(_negatives(second, negatives, share), "window bigint, negative_id bigint, negative bigint, negative_score double")
        order = Window.partitionBy("window").orderBy(F.desc("negative_score"), "negative_id", "negative")
        new = new.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        named = pa.table({"w": window, "anchor_id": ids[anchor], "positive_id": best.column("positive_id"), "positive_score": tops})
        named = spark.createDataFrame(named)
        new = new.join(F.broadcast(named), F.col("window") == F.col("w"))
        new = written(new.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
        found = new if found is None else found.unionByName(new)
        first.destroy()
        second.destroy()
    if found is None:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score double, negative_score double")
    return found


_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v, row_number() OVER () AS place
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.place AS anchor, r.vec_id, r.place, a.label = r.label AS same,
         CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.place <> r.place WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor, anchor_id, vec_id AS positive_id, place AS positive, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, place) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, vec_id, place) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor = s.anchor AND NOT same
  AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""


@query("op12_hard_negatives", _SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, over components scaled to whole numbers."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # What is not finite becomes null, and its row takes no part.
    scaled = F.transform("embedding", lambda x: F.when(F.abs(x) < float("inf"), F.floor(256 * x.cast("double")).cast("double")))
    whole = rows.select("vec_id", "label", scaled.alias("vector"))
    found = hard_negatives(whole, F.col("vec_id") % 100 == 0, label=label)
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("positive_score", "negative_score")})
