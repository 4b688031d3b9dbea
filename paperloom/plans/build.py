"""The incremental build: each step takes what is stored and returns the rows to merge.

``target=None`` is a first or full-refresh run. By default known documents are skipped by
key; ``refresh_changed`` goes by content hash instead, so edited files flow through.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from contextlib import ExitStack
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import infer, marts
from paperloom.operators.chunking import chunk_documents
from paperloom.operators.infer import CLASSIFICATION, EVENTS, EXTRACTION, EmbeddingModel, TextModel
from paperloom.operators.quality import Check, table_checks
from paperloom.operators.relational import in_both
from paperloom.operators.search import keyword_search_many, text_postings
from paperloom.operators.vectors import ListIndex, build_ivf
from paperloom.session import free_shuffles, stored_copy
from paperloom.sources import state, tables
from paperloom.sources.state import DatedTable, KeyedTable


def new_staged(
    target: DataFrame | None,
    raw: DataFrame,
    model: TextModel,
    source: Column | str = "uri",
    start: dt.datetime | str | None = None,
    end: dt.datetime | str | None = None,
    refresh_changed: bool = False,
    workers: int | None = None,
) -> DataFrame:
    """Extracted texts of the PDF files in the time window that are not stored yet."""
    rows = state.time_window(raw.where("content_type = 'application/pdf'"), start, end)
    if refresh_changed:
        rows = state.skip_stored(rows, target, ["uri", "md5_hash"])
    else:
        rows = state.skip_known_texts(rows, target, "uri")
    return marts.stage_texts(infer.infer_text(rows, infer.extraction_prompt(source), model, EXTRACTION, workers=workers))


def new_chunks(target: DataFrame | None, staged: DataFrame, **chunking) -> DataFrame:
    """Chunks of the texts whose (uri, md5_hash) pair has none yet."""
    return chunk_documents(state.skip_stored(staged, target, ["uri", "md5_hash"]), **chunking)


def merge_chunks(target: DataFrame | None, staged: DataFrame, **chunking) -> DataFrame:
    """Drop chunks of changed documents, chunk what is not stored yet; the whole new table."""
    if target is None:
        return new_chunks(None, staged, **chunking)
    kept = state.delete_stale_chunks(target, staged)
    return state.upsert(kept, new_chunks(kept, staged, **chunking), ["document_id", "chunk_index"])


def new_documents(
    target: DataFrame | None,
    chunks: DataFrame,
    staged: DataFrame,
    rules: DataFrame,
    model: TextModel,
    refresh_changed: bool = False,
    workers: int | None = None,
) -> DataFrame:
    """Classified new documents; stored ones are left alone unless refreshed by hash."""
    if refresh_changed:
        rows = state.skip_unchanged(chunks, target, ["document_id", "md5_hash"])
    else:
        rows = state.skip_known(chunks, target, "document_id")
    asked = infer.with_classification_prompt(marts.document_dimension(rows, staged), rules)
    return infer.parse_classification(infer.infer_text(asked, "prompt", model, CLASSIFICATION, workers=workers))


def new_events(
    target: DataFrame | None,
    staged: DataFrame,
    documents: DataFrame,
    model: TextModel,
    extracted_at: Column,
    workers: int | None = None,
    changed: DataFrame | None = None,
) -> DataFrame:
    """Events of the documents that have none stored, and of the ``changed`` ones anew."""
    known = None if target is None else target.select("document_id").distinct()
    if known is not None and changed is not None:
        known = known.join(changed.select("document_id").distinct(), "document_id", "left_anti")
    asked = infer.with_event_prompt(state.skip_known_texts(staged, known, "document_id"), documents)
    generated = infer.infer_text(asked, "prompt", model, EVENTS, workers=workers).where("status = ''")
    return marts.extract_events(generated, extracted_at)


def changed_search_chunks(
    embedded: DataFrame, documents: DataFrame, fresh_vectors: DataFrame, fresh_documents: DataFrame
) -> DataFrame:
    """Rows of the search table that differ from the last run.

    A row depends on its chunk and its document only, so these are the rows of new vectors
    and of new documents; all others would be rebuilt as they are.
    """
    by_chunk = fresh_vectors.select("chunk_id")
    by_document = in_both(embedded, fresh_documents, ["document_id"]).select("chunk_id")
    changed = by_chunk.unionByName(by_document).distinct()
    return marts.denormalise_chunks(in_both(embedded, changed, ["chunk_id"]), documents)


@dataclass
class Models:
    extraction: TextModel
    classification: TextModel
    events: TextModel
    embedding: EmbeddingModel


class Build:
    """All tables of the job under one root, in dependency order.

    Every step ends in a written table; the next reads that table, so a lost executor costs
    a task and never a repeated model call of an earlier step. The large tables are kept in one
    folder per day and only the days a run touches are rewritten; with ``dated=False`` each
    table is kept as complete versions, of which a run leaves the newest: an older one goes as soon
    as the new one is written, which is after the run's last look at it.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        rules: DataFrame,
        models: Models,
        workers: int | None = None,
        dated: bool = True,
    ):
        self.spark, self.root, self.rules, self.models, self.workers = spark, root.rstrip("/"), rules, models, workers
        self.dated = dated
        self.staged = self._table("staged", ["uri"], "updated_day", ["uri"], ["document_id"])
        self.chunks = self._table("chunks", ["document_id", "chunk_index"], "updated_day", ["document_id"], ["document_id"])
        self.embedded = self._table("embedded", ["chunk_id"], "updated_day", ["document_id"])
        self.documents = self._table("documents", ["document_id"], "publish_date", ["document_type"])
        self.events = self._table("events", ["event_id"], "event_date", ["document_id"])
        self.history = KeyedTable(spark, f"{self.root}/sync_history", ["event_id"])
        self.search_chunks = self._table("search_chunks", ["chunk_id"], "publish_date", ["document_id", "document_type"])
        self.postings = self._table("postings", ["document_id", "chunk_index", "token"], "publish_date", ["token", "document_id"], ["token"])
        self.synced_events = KeyedTable(spark, f"{self.root}/events_with_sync", ["event_id"])

    def _table(self, name: str, keys: list[str], day: str, cluster: list[str], lookup: Sequence[str] = ()) -> KeyedTable | DatedTable:
        path = f"{self.root}/{name}"
        return DatedTable(self.spark, path, keys, day, cluster, lookup) if self.dated else KeyedTable(self.spark, path, keys)

    def _dated(self, df: DataFrame) -> DataFrame:
        return df.withColumn("updated_day", F.to_date("updated_at")) if self.dated else df

    def run(
        self,
        raw: DataFrame,
        as_of: dt.date | str,
        source: Column | str = "uri",
        start: dt.datetime | str | None = None,
        end: dt.datetime | str | None = None,
        full_refresh: bool = False,
        refresh_changed: bool = False,
        extracted_at: Column | None = None,
        **chunking,
    ) -> None:
        """One run: ``source`` is what the extraction model is to read of a raw row."""

        def stored(table) -> DataFrame | None:
            return None if full_refresh else table.read()

        with ExitStack() as copies:

            def keep(df: DataFrame, label: str) -> DataFrame:
                """What is read again after its table changed is written aside for the run."""
                return copies.enter_context(stored_copy(df, label))

            def save(table, rows: DataFrame, drop: DataFrame | None = None, **known) -> DataFrame:
                saved = table.overwrite(rows) if full_refresh else table.merge(rows, drop=drop, **known)
                if isinstance(table, KeyedTable):
                    table.expire(1)  # what the run still needs of the older version is written aside
                free_shuffles(self.spark)
                return saved

            def save_once(table, fresh: DataFrame, label: str, drop: DataFrame | None = None) -> DataFrame:
                """``save`` of rows that nothing else reads: their copy goes with it."""
                with stored_copy(fresh, label) as copy:
                    return save(table, copy, drop)

            m, n = self.models, self.workers
            texts = new_staged(stored(self.staged), raw, m.extraction, source, start, end, refresh_changed, n)
            staged = save_once(self.staged, self._dated(texts), "texts")

            old = stored(self.chunks)
            stale = None if old is None else keep(state.stale_documents(old, staged), "stale")
            kept = None if old is None else old.join(stale, "document_id", "left_anti")
            chunks = save_once(self.chunks, self._dated(new_chunks(kept, staged, **chunking)), "chunks", stale)

            old = stored(self.embedded)
            gone = None if old is None else keep(state.orphans(old, chunks), "orphans")
            fresh_vectors = keep(infer.new_embeddings(chunks, old, m.embedding, n), "vectors")
            embedded = save(self.embedded, fresh_vectors, gone)

            old = stored(self.documents)
            typed = new_documents(old, chunks, staged, self.rules, m.classification, refresh_changed, n)
            fresh_documents = keep(typed, "documents")
            documents = save(self.documents, fresh_documents)

            at = F.current_timestamp() if extracted_at is None else extracted_at
            old = stored(self.events)
            found = new_events(old, staged, documents, m.events, at, n, changed=stale)
            # Events of an edited text go with its old chunks, whether the new text has any or not.
            gone_events = None
            if old is not None and stale is not None:
                gone_events = keep(old.join(stale, "document_id", "left_semi").select("event_id"), "old-events")
            events = save_once(self.events, found, "events", gone_events)

            changed = keep(changed_search_chunks(embedded, documents, fresh_vectors, fresh_documents), "search-chunks")
            places = ["document_id", "chunk_index"]
            old, touched = stored(self.search_chunks), changed.select(*places)
            if old is not None and gone is not None:
                touched = touched.unionByName(in_both(old, gone, ["chunk_id"]).select(*places))
            touched = keep(touched.distinct(), "touched")
            save(self.search_chunks, changed, gone)
            # Words of a chunk are distinct and chunks were found unique, so nothing is left to compare.
            words = text_postings(changed, [*places, "publish_date"], "chunk_text")
            save(self.postings, words, touched, check=False, fresh=True)
            self.synced_events.overwrite(marts.events_with_sync(events, documents, self.sync_history(), as_of))
            self.synced_events.expire(1)
        self.history.expire()

    def sync_history(self) -> DataFrame:
        found = self.history.read()
        return tables.empty_table(self.spark, tables.SYNC_HISTORY_SCHEMA) if found is None else found

    def index(self, path: str | None = None, **options) -> ListIndex | None:
        """Inverted lists over the search chunks, only when there are enough of them."""
        return build_ivf(self.search_chunks.read(), path=path, **options)

    def keyword_search_many(self, queries: DataFrame, **options) -> DataFrame:
        """Batch search that looks keywords up in the stored postings."""
        return keyword_search_many(self.search_chunks.read(), queries, postings=self.postings.read(), **options)

    def export(self, path: str, **calendar) -> None:
        """The three read-side shard sets."""
        tables.export_ndjson(marts.export_documents(self.documents.read()), f"{path}/documents", marts.DOCUMENT_EXPORT)
        tables.export_ndjson(marts.export_chunks(self.search_chunks.read()), f"{path}/chunks", marts.CHUNK_EXPORT)
        events = marts.export_events(self.synced_events.read(), **calendar)
        tables.export_ndjson(events, f"{path}/events", marts.EVENT_EXPORT)

    def checks(self) -> list[Check]:
        return declared_checks(
            self.rules,
            self.staged.read(),
            self.chunks.read(),
            self.embedded.read(),
            self.documents.read(),
            self.events.read(),
            self.sync_history(),
            self.synced_events.read(),
            self.search_chunks.read(),
        )


def declared_checks(rules, staged, chunks, embedded, documents, events, history, synced, search) -> list[Check]:
    """The data tests of every layer."""
    out: list[Check] = []

    def add(*args, **kwargs) -> None:
        out.extend(table_checks(*args, **kwargs))

    add("document_type_rules", rules, ["document_type"], ["document_type", "label_ja", "description", "sort_order"])
    add("staged", staged, ["uri"], ["uri", "document_id", "extracted_markdown"])
    chunk_columns = ["document_id", "chunk_id", "chunk_index", "chunk_text"]
    add("chunks", chunks, ["chunk_id"], chunk_columns)
    add("embedded", embedded, ["chunk_id"], [*chunk_columns, "chunk_embedding"])
    add(
        "documents",
        documents,
        ["document_id", "uri"],
        ["document_id", "uri", "title"],
        {"publish_date": "document_type <> 'uncategorized'"},
        [("document_type", rules, "document_type")],
    )
    event_columns = ["event_id", "document_id", "event_date", "event_title", "event_description"]
    add("events", events, ["event_id"], [*event_columns, "extracted_at"], None, [("document_id", documents, "document_id")])
    add("sync_history", history, ["event_id"], ["event_id", "calendar_event_id", "synced_at"])
    add("events_with_sync", synced, ["event_id"], event_columns)
    add(
        "search_chunks",
        search,
        ["chunk_id"],
        [*chunk_columns, "chunk_embedding"],
        None,
        [("document_id", documents, "document_id")],
    )
    return out
