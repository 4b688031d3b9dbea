"""A quality classifier: regularised quadratic discriminant over text statistics.

Each text gives ``FEATURES``: counts and ratios of its bytes, words and lines, each put through a
logarithm or a square root. For each class, Spark sums the features and their products over the
labelled rows that are not held out; the class covariance is drawn to the pooled one by
``TO_POOLED`` and to its own diagonal's mean by ``TO_ROUND``. The score is the logistic of the
difference of the two log densities plus the log odds of the classes; densities come from
Mahalanobis distances over Cholesky factors that are computed once. Labels are all that is learnt
from; language, source and id are no inputs.

A row is held out if the CRC-32 of its id as text leaves ``HELD_OUT`` modulo 4. Nulls: a null
text is empty (its features are defined and it is scored), a null id is never labelled and not
held out. Labels other than 0 and 1 or null are ignored; repeated labels count each. With one
class only or none, every score is the share of label 1, or 0.5. Repeated rows give repeated
results. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import texts as T
from paperloom.llm.store import query, table, written

HELD_OUT = 2
TO_POOLED = 0.3
TO_ROUND = 0.01
THRESHOLD = 0.7

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>@^~=+_\\{}[]",
    "shout": b"!?",
    "stop": b".,;:",
    "white": b" \t\n\v\f\r",
}
FEATURES = (
    "log_words", "log_word_length", "upper", "digit", "symbol", "shout", "stop", "white", "no_letter_words", "one_char_words",
    "repeated_windows", "distinct_words", "same_as_before", "dup_lines", "log_line_words", "top_word",
)


def _in(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    data, at = T.raw(column)
    count = {name: T.per_text(_in(chars)[data], at).astype(float) for name, chars in _CLASSES.items()}
    chars = T.per_text((data & 0xC0) != 0x80, at).astype(float)
    flat, bounds = T.words(column)
    distinct, codes = T.coded(flat)
    n = np.diff(bounds).astype(float)
    own = T.owners(bounds)
    word_data, word_at = T.raw(distinct)
    letters = _in(_CLASSES["upper"] + _CLASSES["lower"]) | (np.arange(256) >= 128)
    bare = T.per_text(letters[word_data], word_at) == 0
    one = np.asarray(pc.utf8_length(distinct)) == 1
    hashes, whole = T.windows(codes, bounds, 5, own)
    twice = np.zeros(len(hashes), bool)
    twice[whole] = T.repeats(hashes[whole]) > 1
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (own[1:] == own[:-1])
    pairs, times = np.unique(own * np.int64(len(distinct) + 1) + codes, return_counts=True)
    of = pairs // (len(distinct) + 1)
    kinds = np.bincount(of, minlength=len(n)).astype(float)
    top = np.zeros(len(n))
    np.maximum.at(top, of, times)
    line, line_bounds = T.lines(column)
    _, line_codes = T.coded(line)
    lines = np.diff(line_bounds).astype(float)
    line_kinds = np.bincount(np.unique(T.owners(line_bounds) * np.int64(len(line) + 1) + line_codes) // (len(line) + 1), minlength=len(n))
    some, most = np.maximum(n, 1), np.maximum(chars, 1)
    letters_count = np.maximum(count["upper"] + count["lower"], 1)
    return np.stack(
        [
            np.log1p(n),
            np.log1p((chars - count["white"]) / some),
            np.sqrt(count["upper"] / letters_count),
            np.sqrt(count["digit"] / most),
            np.sqrt(count["symbol"] / most),
            np.sqrt(count["shout"] / most),
            np.sqrt(count["stop"] / most),
            np.sqrt(count["white"] / most),
            np.sqrt(T.per_text(bare[codes], bounds) / some),
            np.sqrt(T.per_text(one[codes], bounds) / some),
            np.sqrt(T.per_text(T.covered(twice, 5, len(codes)), bounds) / some),
            np.log((kinds + 1) / (n + 1)),
            np.sqrt(T.per_text(again, bounds) / some),
            np.sqrt((lines - line_kinds) / np.maximum(lines, 1)),
            np.log1p(n / np.maximum(lines, 1)),
            np.sqrt(top / (n + 10)),
        ],
        axis=1,
    )


def _featured(batches):
    for batch in T.slices(batches):
        x = features(T.column(batch, "text"))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "x"])


def text_features(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, x): the features of every text."""
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_featured, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


# --- fitting -----------------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _moments(batches):
    """A task's counts, sums and products: one row per class and matrix cell."""
    size = len(FEATURES) + 1
    sums = np.zeros((2, size, size))
    for batch in batches:
        x = _matrix(batch.column(1)) if batch.num_rows else np.zeros((0, size - 1))
        x = np.hstack([np.ones((len(x), 1)), x])
        y = np.asarray(batch.column(0))
        for k in (0, 1):
            sums[k] += x[y == k].T @ x[y == k]
    label, i, j = np.indices(sums.shape).reshape(3, -1)
    yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)) for v in (label, i, j)] + [pa.array(sums.reshape(-1))], ["label", "i", "j", "v"])


def fit(known: DataFrame) -> dict:
    """Means, inverse Cholesky factors, log determinants and log odds from (label, x)."""
    size = len(FEATURES) + 1
    sums = np.zeros((2, size, size))
    cells = known.select(F.col("label").cast("int"), "x").mapInArrow(_moments, "label int, i int, j int, v double")
    for r in cells.groupBy("label", "i", "j").agg(F.sum("v").alias("v")).collect():  # 2 x size x size rows
        sums[r.label, r.i, r.j] = r.v
    return solve(sums)


def solve(sums: np.ndarray, to_pooled: float = TO_POOLED, to_round: float = TO_ROUND) -> dict:
    n = sums[:, 0, 0]
    share = float(n[1] / n.sum()) if n.sum() else 0.5
    if n.min() < 2:
        return {"share": share}
    means = sums[:, 0, 1:] / n[:, None]
    scatter = [sums[k, 1:, 1:] - n[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / (n.sum() - 2)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    factors, dets = [], []
    for k in (0, 1):
        own = (1 - to_pooled) * scatter[k] / (n[k] - 1) + to_pooled * pooled
        own = own / np.outer(scale, scale)
        own = (1 - to_round) * own + to_round * (np.trace(own) / len(own) + 1e-6) * np.eye(len(own))
        lower = np.linalg.cholesky(own)
        factors.append(np.linalg.inv(lower) / scale)
        dets.append(2 * np.log(np.diag(lower)).sum())
    return {"share": share, "means": means, "factors": factors, "dets": dets, "odds": float(np.log(n[1] / n[0]))}


def scores(x: np.ndarray, model: dict) -> np.ndarray:
    if "means" not in model:
        return np.full(len(x), model["share"])
    density = []
    for k in (0, 1):
        z = (x - model["means"][k]) @ model["factors"][k].T
        density.append(-0.5 * ((z * z).sum(axis=1) + model["dets"][k]))
    return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + model["odds"], -500, 500)))


def _scored(model):
    def run(batches):
        for batch in batches:
            s = scores(_matrix(batch.column(1)), model) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", label: str = "quality") -> DataFrame:
    """One row per row of ``docs``: (doc_id, held_out, score, predicted)."""
    found = written(text_features(docs, id_column), "classifier-features")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))
    known = labels.select(F.col(id_column).alias("l_id"), F.col(label).alias("label")).where("label IN (0, 1)")
    known = found.where(~held).join(known, F.col("doc_id") == F.col("l_id")).select("label", "x")
    out = found.mapInArrow(_scored(fit(known)), f"doc_id {found.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query("op10_discriminant")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
