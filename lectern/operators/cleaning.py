"""Raw blocks to clean text: what each block is, and which blocks repeat what was said already."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.ordering import number
from lectern.operators.structure import boundary_lines
from lectern.session import cut_lineage

#: The mark of a table in raw text, and labels that a slide's extraction puts before its fields.
TABLE_MARK = r"^===== TABLE ([1-9][0-9]*) =====$"
FIELD_LABEL = r"^(?:TITLE|CONTENT|NOTES):(?= |$)"

#: A table is looked back to over so many blocks; it and its copy have so many words at least.
WINDOW, LEAST = 8, 4


def contained_words(words: str, whole: str):
    """Whether every word of an array stands in another at least as often."""
    times = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    return F.forall(F.array_distinct(words), lambda x: times(F.col(words), x) <= times(F.col(whole), x))


def echoes(blocks: DataFrame) -> DataFrame:
    """``document_id, block_id, table_block_id``: blocks whose words a table close before them holds as often.

    ``blocks``: ``document_id, block_id, page, at`` (place on the page from 0)
    and ``text``. A block with bars is a table row. What stands between a table
    and the next one (or the mark of one) can be its echo, within ``WINDOW``
    blocks; a table that opens its page has none. The table that governs a
    block is the last one before it, so a page is read once by a window.
    """
    bar, mark = F.contains("text", F.lit("|")), F.col("text").rlike(TABLE_MARK)
    w = F.regexp_extract_all(X.fold_case(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    b = blocks.select("document_id", "page", "at", "block_id", F.coalesce(bar, F.lit(False)).alias("bar"), F.coalesce(bar | mark, F.lit(False)).alias("stop"), w.alias("w"))
    before = Window.partitionBy("document_id", "page").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("stop"), F.struct("at", "bar", "block_id", F.when(F.col("bar"), F.col("w")).alias("w"))), ignorenulls=True).over(before)
    g = b.withColumn("table", last).filter(~F.col("stop") & F.col("table.bar") & (F.col("table.at") > 0) & (F.col("at") - F.col("table.at") <= WINDOW) & (F.size("w") >= LEAST) & (F.size("table.w") >= LEAST))
    return g.withColumn("tw", F.col("table.w")).filter(contained_words("w", "tw")).select("document_id", "block_id", F.col("table.block_id").alias("table_block_id"))


def clean_pages(raw: DataFrame) -> DataFrame:
    """``document_id, block_id, page, ordinal, text, transformation, classification, retained, reason`` of every raw block.

    ``raw``: ``document_id, block_id, page, place, text``, one row per block.
    Texts are cleaned, labels of slide fields and marks of scanners taken off
    and blocks classified. Dropped are: every line but the first that returns
    at the head or foot of half the pages; a block with the text of the last
    one kept on its page; a block that a table close before it holds already.
    A block dropped as one of the latter two is no block to compare with, so
    the last one kept is the last that is no echo and no repeated line,
    whether it was itself a repetition: all of them have its text.

    Keys are hashed and counted with map-side combination; a page is a task's
    unit, a document never is.
    """
    c = X.cleaned(F.col("text"))
    label = F.coalesce(F.col("c.text").rlike(FIELD_LABEL), F.lit(False))
    bare = F.when(label, X.strip(F.regexp_replace("c.text", FIELD_LABEL, ""))).otherwise(F.col("c.text"))
    rows = raw.select("document_id", "block_id", "page", "place", F.coalesce("text", F.lit("")).alias("text")).withColumn("c", c).withColumns({"label": label, "bare": bare})
    scan = F.col("bare").rlike(X.SCANNER_ONLY)
    rows = rows.withColumn("scan", scan).select("document_id", "block_id", "page", "place", F.when(F.col("scan"), "").otherwise(F.col("bare")).alias("text"), F.when(F.col("label") | F.col("scan"), "metadata_classification").otherwise(F.col("c.transformation")).alias("transformation"))
    key = X.key_text(F.col("text"))
    b = cut_lineage(number(rows, ["document_id"], ["page"], ["place", "block_id"]).withColumn("key", F.when(F.col("text") != "", F.unhex(F.md5(key)))))
    lines = b.filter(F.col("key").isNotNull() & ~F.col("text").rlike(TABLE_MARK)).select("document_id", "block_id", "page", F.col("ordinal").alias("reading_order"), F.length("text").alias("size"), F.hex("key").alias("key"))
    often = boundary_lines(lines).groupBy("document_id", F.unhex("key").alias("key")).agg(F.max(F.col("side") == "header").alias("head"))
    returning = b.select("document_id", "key", "ordinal").join(often, ["document_id", "key"]).groupBy("document_id", "key", "head").agg(F.min("ordinal").alias("first"))
    echo = echoes(b.select("document_id", "block_id", "page", (F.row_number().over(Window.partitionBy("document_id", "page").orderBy("ordinal")) - 1).alias("at"), "text")).select("document_id", "block_id", F.lit(True).alias("echo"))
    m = b.join(returning, ["document_id", "key"], "left").join(echo, ["document_id", "block_id"], "left")
    m = m.withColumns({"again": F.coalesce(F.col("ordinal") > F.col("first"), F.lit(False)), "echo": F.coalesce("echo", F.lit(False))})
    before = Window.partitionBy("document_id", "page").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("key").isNotNull() & ~F.col("again") & ~F.col("echo"), F.col("key")), ignorenulls=True).over(before)
    m = m.withColumn("same", F.coalesce(~F.col("again") & (F.col("key") == last), F.lit(False)))
    echo_now = F.col("echo") & ~F.col("again") & ~F.col("same")
    kind = F.when(F.col("again"), F.when(F.col("head"), "repeated_header").otherwise("repeated_footer")).otherwise(X.metadata_class(F.col("text"), F.col("ordinal") - 1))
    reason = F.when(F.col("again"), F.when(F.col("head"), "repeated header").otherwise("repeated footer")).when(F.col("same"), "repeats the block before").when(echo_now, "repeats a table")
    return m.select(
        "document_id", "block_id", "page", "ordinal", "text", F.when(reason.isNotNull(), "duplicate_suppression").otherwise(F.col("transformation")).alias("transformation"),
        kind.alias("classification"), reason.isNull().alias("retained"), reason.alias("reason"),
    )


def clean_texts(cleaned: DataFrame, kinds: DataFrame | None = None, mode: str = "compact") -> DataFrame:
    """``document_id, text``: the cleaned text of each document: marks of its locations in the wished form, and the blocks kept, parted by blank lines.

    ``cleaned`` as :func:`clean_pages` gives it; ``kinds``: ``document_id,
    location_type`` (``page`` where it is not given). A page's blocks are
    gathered first, then a document's pages, since that text is what is asked for.
    """
    kept = cleaned.filter(F.col("retained") & (F.col("text") != ""))
    pages = kept.groupBy("document_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n\n").alias("body"))
    located = pages.join(kinds, "document_id", "left") if kinds is not None else pages.withColumn("location_type", F.lit("page"))
    kind = F.when(F.col("page").isNull(), "document").otherwise(F.coalesce("location_type", F.lit("page")))
    original = F.concat(F.lit("===== "), F.upper(kind), F.lit(" "), F.col("page").cast("string"), F.lit(" ====="))
    marked = F.concat_ws("\n\n", X.location_marker(kind, F.col("page"), original, mode), F.col("body"))
    return located.groupBy("document_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", marked.alias("body")))), lambda x: x["body"]), "\n\n"), F.lit("\n")).alias("text"))
