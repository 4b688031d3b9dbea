"""Batch inference around a pluggable model.

Only the prompt column travels to Python, in Arrow batches; every other column stays in
the JVM. The call is marked non-deterministic so that the optimizer neither repeats it nor
moves a filter on its result in front of it: one call per row.
"""

from __future__ import annotations

import json as pyjson
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom import fixed
from paperloom.functions import dates, json
from paperloom.functions.text import _col, let
from paperloom.operators.relational import ordered_text
from paperloom.sources.state import delete_orphans, skip_stored, upsert


@dataclass(frozen=True)
class ResultSpec:
    """What a model is asked to return: fields, enum values, limits."""

    required: tuple[str, ...]
    nullable: tuple[str, ...] = ()
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    arrays: tuple[str, ...] = ()
    max_tokens: int = fixed.EXTRACTION_TOKENS
    temperature: float = fixed.TEMPERATURE


EXTRACTION = ResultSpec(required=("extracted_markdown",), max_tokens=fixed.EXTRACTION_TOKENS)
CLASSIFICATION = ResultSpec(
    required=("document_type",),
    nullable=("publish_date",),
    enums={"document_type": fixed.DOCUMENT_TYPES},
    max_tokens=fixed.CLASSIFICATION_TOKENS,
)
EVENTS = ResultSpec(required=(), arrays=("events",), max_tokens=fixed.EVENT_TOKENS)
EVENT_ITEM = ResultSpec(required=("event_date", "event_title", "event_description"), nullable=("event_time",))


class TextModel(Protocol):
    """One (result JSON, status) pair per prompt; an empty status means success."""

    def generate(self, prompts: Sequence[str | None], spec: ResultSpec) -> list[tuple[str | None, str]]: ...


class EmbeddingModel(Protocol):
    width: int

    def embed(self, texts: Sequence[str | None], task_type: str) -> list[Sequence[float] | None]: ...


# --- calls -----------------------------------------------------------------------------

#: Bytes of prompts that a model gets, and a task holds results of, at a time.
CALL_BYTES = 4 << 20


def _calls(batches: Iterator[pa.Array]) -> Iterator[list[str | None]]:
    """Texts in lists of ``CALL_BYTES`` bytes at most, or of one longer text."""
    for texts in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), dtype=np.int64)
        start = 0
        while start < len(texts):
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + CALL_BYTES, side="right")))
            yield texts.slice(start, stop - start).to_pylist()
            start = stop


_RESULT = T.StructType([T.StructField("result", T.StringType()), T.StructField("status", T.StringType())])


def infer_text(
    df: DataFrame,
    prompt: Column | str,
    model: TextModel,
    spec: ResultSpec,
    result: str = "llm_result",
    status: str = "status",
    workers: int | None = None,
) -> DataFrame:
    """Add result and status columns; ``workers`` bounds the concurrent calls."""

    @F.arrow_udf(_RESULT)
    def call(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for prompts in _calls(batches):
            pairs = model.generate(prompts, spec)
            parts = [pa.array([p[k] for p in pairs], pa.string()) for k in range(2)]
            yield pa.StructArray.from_arrays(parts, ["result", "status"])

    rows = df if workers is None else df.repartition(workers)
    return (
        rows.withColumn("_call", call.asNondeterministic()(_col(prompt)))
        .withColumn(result, F.col("_call.result"))
        .withColumn(status, F.col("_call.status"))
        .drop("_call")
    )


def infer_embedding(
    df: DataFrame,
    content: Column | str,
    model: EmbeddingModel,
    task_type: str = fixed.DOCUMENT_TASK,
    name: str = "chunk_embedding",
    workers: int | None = None,
) -> DataFrame:
    """Add one vector per row. A failed call leaves NULL; search drops such rows."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def call(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in _calls(batches):
            vectors = model.embed(texts, task_type)
            yield pa.array([None if v is None else np.asarray(v, dtype=np.float32) for v in vectors], pa.list_(pa.float32()))

    rows = df if workers is None else df.repartition(workers)
    return rows.withColumn(name, call.asNondeterministic()(_col(content)))


# --- prompts ---------------------------------------------------------------------------


def extraction_prompt(source: Column | str = "uri") -> Column:
    """Extraction instructions followed by what to read: a file's uri, or text itself."""
    return F.concat(F.lit(fixed.EXTRACTION_PROMPT + "\n\n"), _col(source))


def rules_text(rules: DataFrame) -> DataFrame:
    """One row: the ordered list of document types and what they mean."""
    line = F.concat(F.lit("- "), F.col("document_type"), F.lit(": "), F.col("description"))
    return rules.where(line.isNotNull()).agg(ordered_text(line, "\n", "sort_order").alias("rules_text"))


def with_classification_prompt(documents: DataFrame, rules: DataFrame) -> DataFrame:
    """Prompt per document; the rule text is a one-row scalar subquery, not a join."""
    return documents.withColumn(
        "prompt",
        F.concat(
            F.lit(fixed.CLASSIFICATION_PROMPT_HEAD),
            F.col("title"),
            F.lit(fixed.CLASSIFICATION_PROMPT_RULES),
            rules_text(rules).scalar(),
        ),
    )


def with_event_prompt(staged: DataFrame, documents: DataFrame) -> DataFrame:
    """Prompt per text with the publish date of its document, or the update date."""
    published = documents.select("document_id", "publish_date")
    day = F.coalesce("publish_date", F.to_date("updated_at"))
    return staged.join(published, "document_id", "left").withColumn(
        "prompt",
        F.concat(
            F.lit(fixed.EVENT_PROMPT_HEAD),
            dates.padded_date_label(day),
            F.lit(fixed.EVENT_PROMPT_RULES),
            F.col("extracted_markdown"),
        ),
    )


# --- results ---------------------------------------------------------------------------


def result_problem(result: Column | str, spec: ResultSpec) -> Column:
    """NULL for a result that follows ``spec``, else what is wrong with it."""
    names = list(dict.fromkeys([*spec.required, *spec.enums]))

    def check(body: Column, values: Column | None) -> Column:
        found = F.when(body.isNull(), F.lit("malformed"))
        for name in spec.required:
            found = found.when(values[name].isNull(), F.lit(f"missing {name}"))
        for name, allowed in spec.enums.items():
            found = found.when(values[name].isNotNull() & ~values[name].isin(*allowed), F.lit(f"unknown {name}"))
        for name in spec.arrays:
            present = F.try_variant_get(body, f"$.{name}", "variant").isNotNull()
            found = found.when(present & json.items(body, f"$.{name}").isNull(), F.lit(f"no array {name}"))
        return found

    def checked(text: Column) -> Column:
        if not names:
            return let(json.parse(text), lambda body: check(body, None))
        pair = F.struct(json.parse(text).alias("body"), json.scalars(text, names).alias("values"))
        return let(pair, lambda p: check(p["body"], p["values"]))

    return let(_col(result), checked)


def validate_result(df: DataFrame, spec: ResultSpec, result: str = "llm_result") -> DataFrame:
    return df.withColumn("problem", result_problem(result, spec)).withColumn("is_valid", F.col("problem").isNull())


def parse_classification(generated: DataFrame, result: str = "llm_result", status: str = "status") -> DataFrame:
    """Type and publish date of successful results; no or a bad date means the update date."""
    fields = json.scalars(result, ["document_type", "publish_date"])
    return (
        json.expand(generated.where(F.col(status) == ""), fields)
        .withColumn("publish_date", F.coalesce(dates.safe_date("publish_date"), F.to_date("updated_at")))
        .select(
            "document_id",
            "uri",
            "title",
            "content_type",
            "size",
            "md5_hash",
            "total_chunks",
            "updated_at",
            "document_type",
            "publish_date",
        )
    )


def new_embeddings(
    chunks: DataFrame,
    target: DataFrame | None,
    model: EmbeddingModel,
    workers: int | None = None,
) -> DataFrame:
    """Vectors of the chunks whose (chunk_id, md5_hash) pair has none yet."""
    fresh = skip_stored(chunks, target, ["chunk_id", "md5_hash"])
    return infer_embedding(fresh, "chunk_text", model, workers=workers)


def incremental_embed(
    chunks: DataFrame, target: DataFrame | None, model: EmbeddingModel, workers: int | None = None
) -> DataFrame:
    """Embed only new or changed chunks, drop orphans, return the whole new table."""
    kept = None if target is None else delete_orphans(target, chunks, "chunk_id")
    return upsert(kept, new_embeddings(chunks, target, model, workers), ["chunk_id"])


# --- offline models: pure functions of the row, for tests and dry runs ---------------------


class EchoExtractor:
    """Returns what it was asked to read as the extracted text; blank sources fail."""

    def generate(self, prompts, spec):
        sources = [(p or "").removeprefix(fixed.EXTRACTION_PROMPT + "\n\n") for p in prompts]
        return [
            (pyjson.dumps({"extracted_markdown": s}, ensure_ascii=False), "") if s.strip() else (None, "EMPTY")
            for s in sources
        ]


class KeywordClassifier:
    """Type of the first keyword found in the file-name line of the prompt."""

    def __init__(self, keywords: dict[str, str], default: str = "uncategorized"):
        self.keywords, self.default = dict(keywords), default

    def generate(self, prompts, spec):
        out = []
        for p in prompts:
            if p is None:
                out.append((None, "EMPTY"))
                continue
            name = p.removeprefix(fixed.CLASSIFICATION_PROMPT_HEAD).split("\n", 1)[0]
            kind = next((t for word, t in self.keywords.items() if word in name), self.default)
            day = re.search(r"(\d{4})[-年](\d{1,2})[-月](\d{1,2})", name)
            body = {"document_type": kind, "publish_date": "-".join(day.groups()) if day else None}
            out.append((pyjson.dumps(body, ensure_ascii=False), ""))
        return out


class DatedLineExtractor:
    """One event per line that carries a date; the line is title and description."""

    _DAY = re.compile(r"(\d{4})[-年](\d{1,2})[-月](\d{1,2})日?")
    _CLOCK = re.compile(r"(\d{1,2}:\d{2})")

    def generate(self, prompts, spec):
        out = []
        for p in prompts:
            if p is None:
                out.append((None, "EMPTY"))
                continue
            text = p.split(fixed.EVENT_PROMPT_RULES, 1)[-1]
            events = []
            for line in text.split("\n"):
                day = self._DAY.search(line)
                if day:
                    rest = line[day.end():]
                    clock = self._CLOCK.search(rest)
                    events.append(
                        {
                            "event_date": "-".join(day.groups()),
                            "event_time": clock.group(1) if clock else None,
                            "event_title": self._CLOCK.sub("", rest, count=1).strip(),
                            "event_description": line.strip(),
                        }
                    )
            out.append((pyjson.dumps({"events": events}, ensure_ascii=False), ""))
        return out


class HashingEmbedder:
    """Signed feature hashing of whitespace tokens and character pairs, unit length."""

    def __init__(self, width: int = fixed.EMBEDDING_WIDTH):
        self.width = width

    def embed(self, texts, task_type):
        return [None if t is None or not t.strip() else self._one(t) for t in texts]

    def _one(self, text: str) -> np.ndarray:
        words = np.array([zlib.crc32(w.encode()) for w in text.lower().split()], dtype=np.uint64)
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        pairs = (points[:-1] * np.uint64(2654435761) + points[1:] * np.uint64(40503)) & np.uint64(0xFFFFFFFF)
        codes = np.concatenate([words, pairs, np.zeros(1, dtype=np.uint64)])
        signs = np.where((codes >> np.uint64(20)) & np.uint64(1), 1.0, -1.0)
        vector = np.bincount((codes % np.uint64(self.width)).astype(np.int64), weights=signs, minlength=self.width)
        norm = np.linalg.norm(vector)
        if norm == 0:
            vector[0], norm = 1.0, 1.0
        return (vector / norm).astype(np.float32)


class LetterEmbedder:
    """How often each letter occurs; a query says only whether it does. Plain enough for SQL."""

    def __init__(self, letters: str = "etaoinsrhldcumfpgwybvkxjqz"):
        self.letters, self.width = letters, len(letters)

    def embed(self, texts, task_type):
        most = 1 if task_type == fixed.QUERY_TASK else None
        return [None if t is None else [float(t.count(c) if most is None else min(t.count(c), most)) for c in self.letters] for t in texts]
