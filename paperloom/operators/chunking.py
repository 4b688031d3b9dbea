"""Structure-aware chunking, computed inside each row.

A text never leaves its row while it is cut: headings, paragraphs, table protection and
sentence grouping are array expressions, so the job is a scan followed by one
``posexplode`` and needs no shuffle. Chunks come out already in document order, so the
array position is the chunk number. Only when several rows share one document id must
their chunks be numbered together; ``number_shared`` does that without putting a hot id
into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom import fixed
from paperloom.functions.text import (
    _col,
    let,
    literal_split,
    md5_id,
    normalize_newlines,
    ws_ltrim,
    ws_trim,
)

CARRIED = ("uri", "content_type", "size", "md5_hash", "updated_at")


def split_by_headings(c: Column | str, mark: str = fixed.SECTION_MARK) -> Column:
    """Array of sections; every heading line opens a new one."""
    marked = F.regexp_replace(
        F.concat(F.lit("\n"), _col(c)), fixed.HEADING_PATTERN, f"\n{mark}\n$1"
    )
    return literal_split(marked, mark)


def is_table(paragraph: Column) -> Column:
    return ws_ltrim(paragraph).startswith(fixed.TABLE_MARK)


def _paragraphs(section: Column, paragraph_mark: str) -> Column:
    """Non-empty trimmed paragraphs with their offset in the section."""
    parts = F.transform(
        literal_split(ws_trim(section), paragraph_mark),
        lambda p, i: F.struct(i.alias("at"), ws_trim(p).alias("text")),
    )
    return F.filter(parts, lambda p: p["text"] != "")


def _joined(paragraphs: Column, separator: str) -> Column:
    return F.array_join(F.transform(paragraphs, lambda p: p["text"]), separator)


def _blocks(paragraphs: Column, paragraph_mark: str) -> Column:
    """Merge neighbouring paragraphs of one kind: array<struct<at, table, text>>."""

    def merge(typed: Column) -> Column:
        n = F.size(typed)
        starts = F.filter(
            F.sequence(F.lit(1), n),
            lambda k: (k == 1)
            | (F.element_at(typed, k)["table"] != F.element_at(typed, F.greatest(k - 1, F.lit(1)))["table"]),
        )

        def cut(bounds: Column) -> Column:
            def block(start: Column, i: Column) -> Column:
                first = F.element_at(typed, start)
                stop = F.coalesce(F.get(bounds, i + 1), n + 1)
                run = F.slice(typed, start, stop - start)
                text = F.when(first["table"], _joined(run, "\n")).otherwise(_joined(run, paragraph_mark))
                return F.struct(first["at"].alias("at"), first["table"].alias("table"), text.alias("text"))

            return F.transform(bounds, block)

        return let(starts, cut)

    def single(ps: Column) -> Column:
        return F.array(
            F.struct(
                F.element_at(ps, 1)["at"].alias("at"),
                F.lit(False).alias("table"),
                _joined(ps, paragraph_mark).alias("text"),
            )
        )

    def choose(ps: Column) -> Column:
        typed = F.transform(
            ps,
            lambda p: F.struct(
                p["at"].alias("at"), p["text"].startswith(fixed.TABLE_MARK).alias("table"), p["text"].alias("text")
            ),
        )
        return (
            F.when(F.size(ps) == 0, F.array().cast("array<struct<at:int,table:boolean,text:string>>"))
            .when(F.exists(ps, lambda p: p["text"].startswith(fixed.TABLE_MARK)), let(typed, merge))
            .otherwise(single(ps))
        )

    return let(paragraphs, choose)


def _windows(text: Column, size: int) -> Column:
    """The text in windows of ``size`` characters, cut in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def _sentence_groups(block: Column, limit: int, sentence_mark: str) -> Column:
    """Cut a long block after sentences: array<struct<group, text>>.

    The group of a sentence is floor(running length / limit), where every sentence counts
    one more than its characters. With the sentences joined by a one-character mark, the
    running length is simply the position of the mark after the sentence, so a group ends
    at the last mark inside its ``limit``-wide window. The text is cut into windows once and
    each group joins what it needs of them, so the cost is linear in the text.
    """
    sentences = F.filter(
        F.transform(literal_split(block, sentence_mark), ws_trim), lambda s: s != ""
    )
    mark = F.lit(sentence_mark)

    def halves(window: Column) -> Column:
        kept = F.length(window) - F.instr(F.reverse(window), mark) + 1
        return F.when(
            F.contains(window, mark),
            F.struct(
                F.substring(window, F.lit(1), kept - 1).alias("head"),
                F.substring(window, kept + 1, F.length(window)).alias("tail"),
            ),
        )

    def grouped(windows: Column) -> Column:
        def with_halves(cut: Column) -> Column:
            marked = F.filter(F.sequence(F.lit(0), F.size(cut) - 1), lambda g: F.get(cut, g).isNotNull())

            def pieces(ends: Column) -> Column:
                def piece(g: Column, i: Column) -> Column:
                    before = F.when(i > 0, F.get(ends, F.greatest(i - 1, F.lit(0)))).otherwise(-1)
                    left = F.when(i > 0, F.get(cut, F.greatest(before, F.lit(0)))["tail"]).otherwise("")
                    between = F.array_join(F.slice(windows, before + 2, g - before - 1), "")
                    text = F.concat(left, between, F.get(cut, g)["head"])
                    # The character put before the text is in the first group.
                    text = F.when(i > 0, text).otherwise(F.substring(text, F.lit(2), F.length(text)))
                    return F.struct(g.alias("group"), text.alias("text"))

                return F.transform(ends, piece)

            return let(marked, pieces)

        return let(F.transform(windows, halves), with_halves)

    none = F.array().cast("array<struct<group:int,text:string>>")
    return let(
        sentences,
        lambda s: F.when(F.size(s) == 0, none).otherwise(
            # One character more in front: window g then holds the positions from g * limit.
            let(_windows(F.concat(F.lit("."), F.array_join(s, sentence_mark), mark), limit), grouped)
        ),
    )


def chunk_array(
    text: Column | str,
    limit: int = fixed.BLOCK_LIMIT,
    sentence_mark: str = fixed.SENTENCE_MARK,
    paragraph_mark: str = fixed.PARAGRAPH_MARK,
    min_chars: int = fixed.MIN_CHUNK,
) -> Column:
    """All chunks of a text in order: array<struct<section, block, group, text>>."""
    if len(sentence_mark) != 1:
        raise ValueError("the sentence mark is one character")

    def of_block(b: Column, section: Column) -> Column:
        whole = F.array(
            F.struct(
                F.floor((F.length(b["text"]) + 1) / limit).cast("int").alias("group"), b["text"].alias("text")
            )
        )
        parts = F.when(b["table"] | (F.length(b["text"]) <= limit), whole).otherwise(
            _sentence_groups(b["text"], limit, sentence_mark)
        )
        return F.transform(
            parts,
            lambda p: F.struct(
                section.alias("section"), b["at"].alias("block"), p["group"].alias("group"), p["text"].alias("text")
            ),
        )

    groups = _per_section(
        text, lambda s, i: F.flatten(F.transform(_blocks(_paragraphs(s, paragraph_mark), paragraph_mark), lambda b: of_block(b, i)))
    )
    # Blocks and sentence groups start and end in trimmed text: their length needs no trim.
    return F.filter(groups, lambda c: F.length(c["text"]) >= min_chars)


def _per_section(text: Column | str, body) -> Column:
    return F.flatten(F.transform(split_by_headings(normalize_newlines(text)), body))


def section_array(text: Column | str) -> Column:
    """Sections that hold something: array<struct<section, text>>."""
    found = F.transform(
        split_by_headings(normalize_newlines(text)), lambda s, i: F.struct(i.alias("section"), ws_trim(s).alias("text"))
    )
    return F.filter(found, lambda s: s["text"] != "")


def paragraph_array(text: Column | str, paragraph_mark: str = fixed.PARAGRAPH_MARK) -> Column:
    """Paragraphs and whether they are table rows: array<struct<section, at, table, text>>."""

    def of_section(section: Column, i: Column) -> Column:
        return F.transform(
            _paragraphs(section, paragraph_mark),
            lambda p: F.struct(i.alias("section"), p["at"].alias("at"), is_table(p["text"]).alias("table"), p["text"].alias("text")),
        )

    return _per_section(text, of_section)


def block_array(text: Column | str, paragraph_mark: str = fixed.PARAGRAPH_MARK) -> Column:
    """Runs of paragraphs of one kind, joined: array<struct<section, at, table, text>>."""

    def of_section(section: Column, i: Column) -> Column:
        return F.transform(
            _blocks(_paragraphs(section, paragraph_mark), paragraph_mark),
            lambda b: F.struct(i.alias("section"), b["at"].alias("at"), b["table"].alias("table"), b["text"].alias("text")),
        )

    return _per_section(text, of_section)


def chunk_documents(
    df: DataFrame,
    text: str = "extracted_markdown",
    carried: tuple[str, ...] = CARRIED,
    unique_ids: bool = False,
    id_separator: str = "",
    **options,
) -> DataFrame:
    """Numbered chunks of every document.

    ``unique_ids=True`` states that no two rows share a document id; then the whole job is
    narrow. Otherwise chunks of rows sharing an id are numbered together.
    """
    keys = ["document_id", *[c for c in carried if c in df.columns]]
    exploded = df.select(*keys, F.posexplode(chunk_array(text, **options)).alias("at", "chunk"))
    if unique_ids:
        numbered = exploded.withColumn("chunk_index", F.col("at").cast("long"))
    else:
        numbered = number_shared(
            exploded.select(*keys, "chunk.*").withColumn("chunk", F.struct("text")),
            key="document_id",
            place=["section", "block", "group"],
            owner="uri",
            name="chunk_index",
        )
    return numbered.select(
        *keys,
        "chunk_index",
        F.col("chunk.text").alias("chunk_text"),
        md5_id("document_id", "chunk_index", separator=id_separator).alias("chunk_id"),
    )


def number_shared(
    df: DataFrame, key: str, place: list[str], owner: str, name: str, slices: int = 4096
) -> DataFrame:
    """``row_number() - 1`` per ``key`` ordered by ``place``, then by MD5 of ``owner``.

    A key may own a third of all rows, so no window over rows spans a whole key: rows are
    ranked inside cells of (key, place, slice of the owner's hash) and shifted by the number
    of rows in earlier cells. Only counts meet: those of the first places per key, and at most
    ``slices`` for each later place per first place. The rows are shuffled once.
    """
    owner_hash = F.md5(F.col(owner).cast("string"))
    digits = F.conv(F.substring(owner_hash, 1, 3), 16, 10).cast("int")
    sliced = (
        df.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))
        .withColumn("_hash", owner_hash)
        .withColumn("_slice", F.floor(digits * slices / 4096).cast("int"))
    )
    cell = ["_key", *place, "_slice"]
    counts = sliced.groupBy(*cell).agg(F.count("*").alias("_rows"))
    # Two levels: whole first places (at most the parts of the longest text) meet per key, the
    # cells of one first place among themselves.
    coarse = counts.groupBy("_key", place[0]).agg(F.sum("_rows").alias("_rows"))
    earlier = W.partitionBy("_key").orderBy(place[0]).rowsBetween(W.unboundedPreceding, -1)
    coarse = coarse.select("_key", place[0], F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base"))
    within = W.partitionBy("_key", place[0]).orderBy(*place[1:], "_slice").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_within", F.coalesce(F.sum("_rows").over(within), F.lit(0)))
    offsets = counts.join(coarse, ["_key", place[0]]).select(*cell, (F.col("_base") + F.col("_within")).alias("_offset"))
    inner = W.partitionBy(*cell).orderBy("_hash", owner)
    ranked = sliced.withColumn("_rank", F.row_number().over(inner))
    return (
        ranked.join(offsets, cell, "inner")
        .withColumn(name, (F.col("_offset") + F.col("_rank") - 1).cast("long"))
        .select(*df.columns, name)
    )


def chunk_fixed(
    df: DataFrame,
    text: str,
    size: int = fixed.WINDOW_SIZE,
    sentence_mark: str = fixed.SENTENCE_MARK,
    carry: bool = True,
) -> DataFrame:
    """Fixed windows cut back to just after their last sentence mark.

    With ``carry`` the characters after a cut open the next chunk, so the chunks of a text
    join back to it; without it each window stands alone and its tail is dropped. The last
    window always keeps the rest of the text.
    """
    mark = F.lit(sentence_mark)

    def halves(windows: Column) -> Column:
        def cut(window: Column, i: Column) -> Column:
            back = F.instr(F.reverse(window), mark)
            kept = F.when((back > 0) & (i < F.size(windows) - 1), F.length(window) - back + 1).otherwise(F.length(window))
            return F.struct(
                F.substring(window, F.lit(1), kept).alias("head"), F.substring(window, kept + 1, F.length(window)).alias("tail")
            )

        return F.transform(windows, cut)

    def pieces(cuts: Column) -> Column:
        def piece(cut: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(cuts, F.greatest(i - 1, F.lit(0)))["tail"]).otherwise("")
            return F.concat(before, cut["head"]) if carry else cut["head"]

        return F.transform(cuts, piece)

    windows = F.when(F.col(text) == "", F.array(F.lit(""))).otherwise(_windows(F.col(text), size))
    others = [c for c in df.columns if c != text]
    return df.where(F.col(text).isNotNull()).select(
        *others, F.posexplode(let(let(windows, halves), pieces)).alias("chunk_index", "chunk_text")
    )
