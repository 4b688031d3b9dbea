"""Quality rules: plain text counts, and bands on the perplexity of a Kneser-Ney model.

The model is a modified Kneser-Ney model of order 4 over the characters of a word (the word's
start and end count as characters), one for each language, counted by Spark over every word of
every text. Each task sends one row per distinct character sequence and language it met; the
discounts, the probabilities and the back-off weights are joins and sums in Spark. The finished
model is two arrays, sorted 64-bit hashes of language and sequence and their values, as many as
there are sequences. They are sent to the tasks for as many languages at a time as have
``ENTRIES`` sequences; a language with more goes alone, and each text is scored once.

A text's perplexity is the mean negative log probability of its words, each the sum over its
characters: words with signs grafted onto them and words of another language cost more,
whatever their length. Each language has a lower and an upper band around the median of its
distinct texts, in median absolute deviations. A short text says less, so its band is wider by
``sqrt(1 + PRIOR / words)``, and few texts say less about the deviation, which counts for
``1 + FEW / texts`` times its size and for ``LEAST`` of the median at least, as texts that are all
but alike differ by what happens to be copied. Texts outside are rejected.

Nulls: a null text is empty (no words; it fails the base rules), a null language is a language
of its own, null ids are kept. Rows are never merged: repeated rows give repeated results. An
empty table gives an empty result. Columns other than the id, the text and the language are not
looked at by ``judge`` and are carried through by ``keep_good``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paperloom.llm import texts as T
from paperloom.llm.store import few, query, table, written

ORDER = 4
#: Sequences whose values are sent to the tasks together, at 12 bytes each.
ENTRIES = 1 << 24
BUCKETS = 256  # of languages
HELD = 1 << 19  # sequences that a task counts before it merges them
PRIOR = 30
FEW = 20
LEAST = 0.01
#: Median absolute deviations below and above a language's median.
BANDS = (10.0, 10.0)
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


# --- base counts -------------------------------------------------------------------------


def base_counts(column: pa.Array) -> tuple[dict[str, np.ndarray], tuple]:
    """Counts of each text, and its words as (distinct words, codes, bounds)."""
    data, at = T.raw(column)
    flat, bounds = T.words(column)
    distinct, codes = T.coded(flat)
    own = T.owners(bounds)
    hashes, whole = T.windows(codes, bounds, 5, own)
    twice = np.zeros(len(hashes), bool)
    twice[whole] = T.repeats(hashes[whole]) > 1
    line, line_bounds = T.lines(column)
    _, line_codes = T.coded(line)
    pairs = T.owners(line_bounds) * np.int64(len(line) + 1) + line_codes
    first = np.zeros(len(pairs), np.int64)
    first[np.unique(pairs, return_index=True)[1]] = 1
    counts = {
        "n_words": np.diff(bounds),
        "word_chars": T.per_text(((data & 0xC0) != 0x80) & ~_SPACE[data], at),
        "n_symbols": T.per_text(_SYMBOL[data], at),
        "n_dup_lines": T.per_text(1 - first, line_bounds),
        "n_repeat_words": T.per_text(T.covered(twice, 5, len(codes)), bounds),
    }
    return counts, (distinct, codes, bounds)


# --- character sequences -----------------------------------------------------------------


def sequences(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each character of each word and its end: the last four characters as one number.

    Characters are 16 bits (those beyond the first plane are folded into it); what lies before
    a word's start is a space. Second: the place of the word that the character belongs to.
    """
    joined = " ".join(words.to_pylist()) + " "
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    points = (points ^ ((points >> np.uint64(16)) * np.uint64(40503))) & np.uint64(0xFFFF)
    space = np.uint64(32)
    ends = points == space
    own = np.cumsum(ends) - ends
    keys = points.copy()
    before = points
    for k in range(1, ORDER):
        shifted = np.concatenate([[space], before[:-1]])
        if k > 1:  # nothing before the space that starts a word
            shifted = np.where(before == space, space, shifted)
        keys |= shifted << np.uint64(16 * k)
        before = shifted
    return keys, own


def language_salt(lang: str | None) -> np.uint64:
    return np.uint64(zlib.crc32(b"\0" if lang is None else b"1" + lang.encode()))


def hashes(keys: np.ndarray, order: int, lang: str | None) -> np.ndarray:
    """A sequence's 64-bit hash, with its language and order."""
    salt = T.mix64(np.array([(int(language_salt(lang)) << 8) | order], np.uint64))[0]
    return T.mix64(keys.astype(np.uint64) ^ salt)


def _by_language(langs: pa.Array, words: tuple):
    """(language, rows of it, distinct words, codes, text numbers) for each language of a batch."""
    distinct, codes, bounds = words
    own = T.owners(bounds)
    names = langs.to_pylist()
    for lang in dict.fromkeys(names):
        mine = np.fromiter((x == lang for x in names), bool, len(names))
        at = mine[own]
        used, back = np.unique(codes[at], return_inverse=True)
        yield lang, mine, distinct.take(pa.array(used)), back, own[at]


def _counted(id_free_batches):
    """Each task's character sequences with their counts, by language."""
    held: dict[str | None, list] = {}
    rows = 0

    def merge() -> int:
        """Equal sequences become one; how many are left."""
        for parts in held.values():
            keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            parts[:] = [(keys, np.bincount(back, weights=np.concatenate([p[1] for p in parts])))]
        return sum(len(parts[0][0]) for parts in held.values())

    def flush():
        merge()
        for lang, [(keys, n)] in held.items():
            langs = pa.repeat(pa.scalar(lang, pa.string()), len(keys))
            yield pa.RecordBatch.from_arrays([langs, pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])
        held.clear()

    for batch in T.slices(id_free_batches, 2 << 20):
        flat, bounds = T.words(T.column(batch, "text"))
        distinct, codes = T.coded(flat)
        langs = batch.column(batch.schema.get_field_index("lang")).cast(pa.string())
        for lang, _, own_words, back, _ in _by_language(langs, (distinct, codes, bounds)):
            if not len(own_words):
                continue
            keys, own = sequences(own_words)
            times = np.bincount(back, minlength=len(own_words))[own]
            keys, places = np.unique(keys, return_inverse=True)
            held.setdefault(lang, []).append((keys, np.bincount(places, weights=times)))
            rows += len(keys)
        if rows > HELD:
            rows = merge()
            if rows > HELD // 2:
                yield from flush()
                rows = 0
    yield from flush()


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): every four-character sequence of the corpus and its count."""
    seen = docs.select("lang", "text").mapInArrow(_counted, "lang string, gram bigint, n bigint")
    return seen.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


# --- the model ---------------------------------------------------------------------------


def _discounts(grams: DataFrame) -> DataFrame:
    """Three discounts for each language, from how many sequences occur one to four times."""
    times = grams.groupBy("lang").agg(*[F.sum((F.col("n") == k).cast("double")).alias(f"t{k}") for k in (1, 2, 3, 4)])
    y = F.col("t1") / F.greatest(F.col("t1") + 2 * F.col("t2"), F.lit(1.0))
    out = [F.col("lang").alias("d_lang")]
    for k in (1, 2, 3):
        cut = k - (k + 1) * y * F.col(f"t{k + 1}") / F.greatest(F.col(f"t{k}"), F.lit(1.0))
        # Too few sequences give discounts out of range: then half of the count is kept.
        out.append(F.when((cut > 0) & (cut < k), cut).otherwise(k / 2).alias(f"d{k}"))
    return times.select(*out)


def kneser_ney(grams: DataFrame) -> DataFrame:
    """(lang, kind, key, value, weight): log probabilities (kind = order) and, as kind 10 + length
    of the context, log back-off weights."""
    levels = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):
        short = F.col("gram").bitwiseAND((1 << 16 * k) - 1).alias("gram")
        levels[k] = levels[k + 1].groupBy("lang", short).agg(F.count(F.lit(1)).alias("n"))
    lower, parts = None, []
    for k in range(1, ORDER + 1):
        context = F.shiftrightunsigned("gram", 16) if k > 1 else F.lit(0).cast("long")
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        joined = levels[k].join(few(_discounts(levels[k]), f"kn-discounts-{k}"), F.col("lang").eqNullSafe(F.col("d_lang")))
        own = joined.select("lang", "gram", "n", context.alias("context"), cut.alias("cut"))
        own = written(own, f"kn-counts-{k}")
        totals = own.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("gamma"))
        totals = totals.withColumnsRenamed({"lang": "t_lang", "context": "t_context"})
        p = own.join(totals, F.col("lang").eqNullSafe(F.col("t_lang")) & (F.col("context") == F.col("t_context")))
        direct = (F.col("n") - F.col("cut")) / F.col("total")
        if lower is None:
            p = p.select("lang", "gram", "n", (direct + F.col("gamma") / (1 << 16)).alias("p"))
        else:
            less = lower.select(F.col("lang").alias("l_lang"), F.col("gram").alias("l_gram"), F.col("p").alias("l_p"))
            suffix = F.col("gram").bitwiseAND((1 << 16 * (k - 1)) - 1)
            p = p.join(less, F.col("lang").eqNullSafe(F.col("l_lang")) & (suffix == F.col("l_gram")))
            p = p.select("lang", "gram", "n", (direct + F.col("gamma") * F.col("l_p")).alias("p"))
        lower = p = written(p, f"kn-{k}")
        parts.append(p.select("lang", F.lit(k).alias("kind"), F.col("gram").alias("key"), F.ln("p").alias("value"), F.col("n").alias("weight")))
        parts.append(
            totals.select(
                F.col("t_lang").alias("lang"), F.lit(9 + k).alias("kind"), F.col("t_context").alias("key"), F.ln("gamma").alias("value"), F.col("total").alias("weight")
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _hashed(batches):
    for batch in batches:
        langs, kinds = np.asarray(batch.column(0).to_pylist(), object), np.asarray(batch.column(1))
        keys = np.asarray(batch.column(2)).view(np.uint64)
        found = np.zeros(len(keys), np.uint64)
        for lang, kind in set(zip(langs.tolist(), kinds.tolist(), strict=True)):
            at = (langs == lang) & (kinds == kind)
            found[at] = hashes(keys[at], kind, lang)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), batch.column(3).cast(pa.float32())], ["hash", "value"])


def hash_arrays(model: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all sequences and their values."""
    rows = model.select("lang", "kind", "key", "value").mapInArrow(_hashed, "hash bigint, value float").toArrow()
    found, value = rows.column("hash").to_numpy().view(np.uint64), rows.column("value").to_numpy()
    order = np.argsort(found)
    return found[order], value[order]


def log_probability(keys: np.ndarray, lang: str | None, arrays: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Natural log of each character's probability after the three before it."""
    known_hashes, value = arrays

    def look(k, order):
        own = hashes(k, order, lang)
        at = np.minimum(np.searchsorted(known_hashes, own), max(len(known_hashes) - 1, 0))
        if not len(known_hashes):
            return np.zeros(len(k), bool), np.zeros(len(k))
        return known_hashes[at] == own, value[at].astype(np.float64)

    out, open_at, paid = np.zeros(len(keys)), np.arange(len(keys)), np.zeros(len(keys))
    for order in range(ORDER, 0, -1):
        k = keys[open_at] & np.uint64((1 << 16 * order) - 1)
        found, p = look(k, order)
        out[open_at[found]] = paid[open_at[found]] + p[found]
        open_at = open_at[~found]
        if not len(open_at):
            return out
        known, gamma = look((keys[open_at] & np.uint64((1 << 16 * order) - 1)) >> np.uint64(16), 9 + order)
        paid[open_at] += np.where(known, gamma, 0.0)
    out[open_at] = paid[open_at] - 16 * np.log(2.0)
    return out


# --- the rules ---------------------------------------------------------------------------

_MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, nats double"


def _measured(model):
    def run(batches):
        for batch in T.slices(batches, 1 << 20):
            counts, words = base_counts(T.column(batch, "text"))
            langs = batch.column(batch.schema.get_field_index("lang")).cast(pa.string())
            nats = np.zeros(batch.num_rows)
            for lang, _, distinct, back, text in _by_language(langs, words):
                if not len(distinct):
                    continue
                keys, own = sequences(distinct)
                cost = np.bincount(own, weights=-log_probability(keys, lang, model.value), minlength=len(distinct))
                nats += np.bincount(text, weights=cost[back], minlength=batch.num_rows)
            rest = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            arrays = [batch.column(i) for i in rest] + [pa.array(v.astype(np.int64)) for v in counts.values()] + [pa.array(nats)]
            yield pa.RecordBatch.from_arrays(arrays, [batch.schema.names[i] for i in rest] + [*counts, "nats"])

    return run


_VERDICT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "nats_per_word", "lower", "upper", "base_failed", "kept"]


def judge(docs: DataFrame, carried: Column, bands: tuple[float, float] = BANDS) -> DataFrame:
    """One row per row of ``docs``: the carried column, the counts, the perplexity (nats per
    word), its band, ``base_failed`` and ``kept``."""
    texts = docs.select(carried.alias("carried"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    model = kneser_ney(written(gram_counts(texts.select("lang", "text")), "kn-grams"))
    schema = StructType([texts.schema["carried"], texts.schema["lang"], *StructType.fromDDL(_MEASURES).fields])
    measured, sent = None, []
    for inside in _together(model):
        arrays = docs.sparkSession.sparkContext.broadcast(hash_arrays(model.where(inside)))
        sent.append(arrays)
        some = texts.where(inside).mapInArrow(_measured(arrays), schema)
        measured = some if measured is None else measured.unionByName(some)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    mean = F.col("nats") / F.greatest(F.col("n_words"), F.lit(1))
    measured = written(measured.withColumn("base_failed", failed).withColumn("nats_per_word", mean), "quality")
    for arrays in sent:  # the scores are written: workers need not hold the model any more
        arrays.destroy()
    # Copies score alike: however many there are, they count once.
    good = measured.where("NOT base_failed").select("lang", "n_words", F.col("nats_per_word").alias("mean")).distinct()
    good = written(good, "quality-scores")
    middle = good.groupBy("lang").agg(F.percentile_approx("mean", 0.5, 10000).alias("median"), F.count(F.lit(1)).alias("n_texts"))
    middle = few(middle.withColumnRenamed("lang", "m_lang"), "quality-medians")
    spread = (
        good.join(middle, F.col("lang").eqNullSafe(F.col("m_lang")))
        .groupBy(F.col("lang").alias("b_lang"), "median", "n_texts")
        .agg(F.percentile_approx(F.abs(F.col("mean") - F.col("median")), 0.5, 10000).alias("mad"))
    )
    spread = few(spread.select("b_lang", "median", F.greatest(F.col("mad"), LEAST * F.col("median")).alias("mad"), "n_texts"), "quality-bands")
    out = measured.join(spread, F.col("lang").eqNullSafe(F.col("b_lang")), "left")
    wide = F.col("mad") * (1 + FEW / F.col("n_texts")) * F.sqrt(1 + PRIOR / F.greatest(F.col("n_words"), F.lit(1)))
    out = out.withColumn("lower", F.col("median") - bands[0] * wide).withColumn("upper", F.col("median") + bands[1] * wide)
    fits = F.col("nats_per_word").between(F.col("lower"), F.col("upper"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(fits, F.lit(True))).select("carried", *_VERDICT)


def _together(model: DataFrame) -> list[Column]:
    """Conditions on ``lang`` that part all languages into groups of about ``ENTRIES`` sequences."""
    bucket = F.pmod(F.xxhash64(F.coalesce("lang", F.lit("\0"))), F.lit(BUCKETS))
    sizes = model.groupBy(bucket.alias("bucket")).count().collect()  # BUCKETS rows at most
    groups: list[list[int]] = [[]]
    held = 0
    for b, n in sorted(map(tuple, sizes)):
        if groups[-1] and held + n > ENTRIES:
            groups.append([])
            held = 0
        groups[-1].append(b)
        held += n
    # Texts of a language without any word are in no bucket of the model: they go with the first.
    rest = [b for b in range(BUCKETS) if all(b not in g for g in groups)]
    groups[0] += rest
    return [F.lit(True)] if len(groups) == 1 else [bucket.isin(g) for g in groups]


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    return judge(docs, F.struct("*")).where("kept").select("carried.*")


@query("op8_kneser_ney")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged by the base rules and its language's perplexity band."""
    return judge(table(spark, sf_dir, "documents"), F.col("doc_id")).withColumnRenamed("carried", "doc_id")
