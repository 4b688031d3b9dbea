"""Fill-in-middle: texts are cut at two line ends and their parts put in another order.

A text's units are its lines, each with its line feed. Two hashes of the row's id say after how
many units the prefix and the middle end, two more whether and in which order the parts are put:
``<P>`` prefix ``<S>`` suffix ``<M>`` middle (psm) or ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
(spm). Texts that are empty or hold a marker stay as they are (plain).

A batch of whole texts is seen as blocks of ``BLOCK`` bytes, none of which holds two texts. Two
Fenwick trees over the blocks have the counts of line feeds and of code points. A cut is found by
one binary-lifting descent over the first tree, which adds up the second one's counts on its way;
the line feed itself is then looked for inside the block it ended at. So a cut costs the logarithm
of the text's blocks, and no text is turned into a list of lines.

Nulls: a null text is empty, a null id is hashed as the empty string and kept. Repeated rows give
repeated results. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import texts as T
from paperloom.llm.store import query, table

SEED = 7
RATE = 100  # of 100 texts so many are cut
SPM = 50  # of 100 cut texts so many put the suffix first
BLOCK = 512
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class Fenwick:
    """Sums of the first numbers of an array, and where such sums reach given values."""

    def __init__(self, numbers: np.ndarray):
        n = len(numbers)
        self.tree = np.concatenate([np.zeros(1, np.int64), numbers.astype(np.int64)])
        self.top = 1 << n.bit_length() >> 1
        step = 1
        while step < n:
            own = np.arange(step, n + 1 - step, 2 * step)
            self.tree[own + step] += self.tree[own]
            step *= 2

    def sums(self, ends: np.ndarray) -> np.ndarray:
        """The sum of the first ``ends`` numbers, for each of ``ends``."""
        at, total = ends.astype(np.int64), np.zeros(len(ends), np.int64)
        while at.any():
            total += self.tree[at]
            at &= at - 1
        return total

    def descend(self, wanted: np.ndarray, beside: Fenwick) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The most numbers whose sum is under each of ``wanted``, that sum, and the sum of as many
        numbers of ``beside``."""
        at, own, other = (np.zeros(len(wanted), np.int64) for _ in range(3))
        step, last = self.top, len(self.tree) - 1
        while step:
            to = np.minimum(at + step, last)
            go = (at + step <= last) & (own + self.tree[to] < wanted)
            own += np.where(go, self.tree[to], 0)
            other += np.where(go, beside.tree[to], 0)
            at = np.where(go, to, at)
            step >>= 1
        return at, own, other


class Blocks:
    """Line feeds and code points of a batch of texts, counted by blocks."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, size: int = BLOCK):
        self.data, self.bounds, self.size = data, bounds, size
        per_text = -(-np.diff(bounds) // size)
        self.first = np.concatenate([np.zeros(1, np.int64), np.cumsum(per_text)])
        own = T.owners(self.first)
        self.starts = bounds[:-1][own] + size * (np.arange(self.first[-1]) - self.first[own])
        feeds, points = data == 10, (data & 0xC0) != 0x80
        counted = [np.add.reduceat(x, self.starts, dtype=np.int64) if len(own) else np.zeros(0, np.int64) for x in (feeds, points)]
        self.feeds, self.points = map(Fenwick, counted)
        self.feeds_before, self.points_before = self.feeds.sums(self.first), self.points.sums(self.first)
        long = np.diff(bounds) > 0
        last = np.where(long, data[np.maximum(bounds[1:] - 1, 0)] if len(data) else 0, 10)
        self.units = np.diff(self.feeds_before) + (last != 10)

    def cuts(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The byte, among all of the batch, and the code point, among the text's own, at which
        each text's first ``units`` units end."""
        whole = units >= self.units
        at = np.where(whole, self.bounds[1:], self.bounds[:-1])
        points = np.where(whole, np.diff(self.points_before), 0)
        inside = np.flatnonzero((units > 0) & ~whole)
        for some in np.array_split(inside, len(inside) * self.size // (1 << 22) + 1):
            block, feeds, before = self.feeds.descend(self.feeds_before[some] + units[some], self.points)
            left = self.feeds_before[some] + units[some] - feeds
            start = self.starts[block]
            near = self.data[np.minimum(start[:, None] + np.arange(self.size), len(self.data) - 1)]
            place = np.argmax(np.cumsum(near == 10, axis=1) == left[:, None], axis=1) + 1
            local = np.cumsum((near & 0xC0) != 0x80, axis=1)[np.arange(len(some)), place - 1]
            at[some] = start + place
            points[some] = before - self.points_before[some] + local
        return at, points


def _formed(batches):
    marks = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    for batch in T.slices(batches, 4 << 20):
        doc_id, form, first, second = (batch.column(k) for k in (0, 2, 3, 4))
        data, bounds = T.raw(T.column(batch, "text"))
        blocks = Blocks(data, bounds)
        drawn = [np.asarray(h) % (blocks.units + 1) for h in (first, second)]
        a, a_chars = blocks.cuts(np.minimum(*drawn))
        b, b_chars = blocks.cuts(np.maximum(*drawn))
        whole, parts = data.tobytes(), []
        ends = zip(form.to_pylist(), bounds[:-1].tolist(), a.tolist(), b.tolist(), bounds[1:].tolist(), strict=True)
        for kind, start, cut, end, stop in ends:
            prefix, middle, suffix = whole[start:cut], whole[cut:end], whole[end:stop]
            if kind == "plain":
                parts.append(whole[start:stop])
            elif kind == "psm":
                parts.append(b"".join((marks[0], prefix, marks[1], suffix, marks[2], middle)))
            else:
                parts.append(b"".join((marks[1], suffix, marks[0], prefix, marks[2], middle)))
        plain = np.array([k == "plain" for k in form.to_pylist()], bool)
        yield pa.RecordBatch.from_arrays(
            [doc_id, pa.array(blocks.units), form, pa.array(a_chars, mask=plain), pa.array(b_chars - a_chars, mask=plain), pa.array(parts, pa.binary()).cast(pa.string())],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )


def fill_in_middle(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of ``docs``: the number
    of lines, plain, psm or spm, code points of the parts (null if plain), and the new text."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h1, h2, h3, h4 = (F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return rows.mapInArrow(_formed, schema)


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text before it was cut, from the new text and its form alone."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def between(start: str, end: str) -> Column:
        return F.substring_index(F.substring_index(output, start, -1), end, 1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


_SQL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units,
         list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(sha256('7:' || doc_id), CAST(k AS INTEGER), 8) AS BIGINT)) AS h
  FROM documents),
placed AS (
  SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a,
         greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
              WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parted AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
         array_to_string(units[b + 1:], '') AS suffix FROM placed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parted"""


@query("op11_fill_in_middle", _SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cuts, and the digests of its new text and of the text rebuilt from that."""
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
