"""Documents as ordered blocks in sections: order, furniture, units, atoms, chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.ordering import fold, islands, last_by_level, neighbours, number, running
from lectern.session import cut_lineage


@dataclass(frozen=True)
class Limits:
    """Sizes of chunks in characters."""

    soft: int = 6000
    hard: int = 10000
    least: int = 250
    context: int = 500

    def __post_init__(self) -> None:
        if not 0 < self.least <= self.soft <= self.hard or self.context < 0:
            raise ValueError("sizes must satisfy 0 < least <= soft <= hard and context >= 0")


#: Reading orders in one stretch, by which blocks are sorted first.
ORDERS = 512


def reading_order(blocks: DataFrame) -> DataFrame:
    """Blocks with ``ordinal``: 1, 2, ... by (reading order, page, id) within a document; null orders and pages first.

    Documents are numbered by stretches of the reading order, so one without
    pages is no single task either.
    """
    return number(blocks.withColumn("_stretch", F.floor(F.col("reading_order") / ORDERS)), ["document_id"], ["_stretch"], ["reading_order", "page", "block_id"]).drop("_stretch")


def furniture_key(block_type: str = "block_type", text: str = "text") -> Column:
    """The normalised text of headers and footers, null for other blocks and texts that say nothing."""
    return F.nullif(X.normalize_text(F.when(F.col(block_type).isin("header", "footer"), F.col(text))), F.lit(""))


def repeated_furniture(blocks: DataFrame, least: int = 2) -> DataFrame:
    """Headers and footers that stand at ``least`` places, or are page numbers: ``document_id, block_id, reason``.

    ``blocks``: ``document_id, block_id, page, furniture`` (see
    :func:`furniture_key`). A null page is a place. Places are counted over
    distinct (document, text, page) with map-side combination and joined back.
    """
    f = blocks.filter(F.col("furniture").isNotNull()).select("document_id", "block_id", "page", F.col("furniture").alias("key"))
    place = F.coalesce(F.col("page"), F.lit(-1)).alias("place")
    often = f.select("document_id", "key", place).distinct().groupBy("document_id", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    joined = f.join(often, ["document_id", "key"], "left")
    reason = F.when(F.col("n").isNotNull(), "repeated").when(F.col("key").rlike(X.PAGE_NUMBER), "page_number")
    return joined.select("document_id", "block_id", reason.alias("reason")).filter("reason is not null")


def structural_units(ordered: DataFrame) -> DataFrame:
    """``ordered`` blocks with ``unit``: a new one begins where section, page (of unsectioned blocks or slides) or heading of an unsectioned document changes."""
    sectioned = ordered.groupBy("document_id").agg(F.max(F.col("section_id").isNotNull()).alias("_sectioned"))
    b = ordered.join(sectioned, "document_id")
    head = (~F.col("_sectioned") & (F.col("block_type") == "heading")).cast("int")
    b = running(b, ["document_id"], "ordinal", head, "_provisional")
    place = F.when(F.col("section_id").isNull() | (F.col("location_type") == "slide"), F.col("page"))
    scope = F.coalesce(F.col("section_id"), F.when(~F.col("_sectioned") & (F.col("_provisional") > 0), F.concat(F.lit("provisional-"), F.col("_provisional"))))
    b = b.withColumns({"_scope": scope, "_place": place})
    return islands(b, ["document_id"], "ordinal", ["_scope", "_place"], "unit").withColumn("scope", F.col("_scope")).drop("_sectioned", "_provisional", "_scope", "_place")


def captions_of(ordered: DataFrame) -> DataFrame:
    """``document_id, object_block, caption_block`` of tables and figures: the caption after them, else the one before, of the same page."""
    wanted = {f"{n}_{short}": (c, step) for n, step in (("a", 1), ("b", -1)) for short, c in (("type", "block_type"), ("page", "page"), ("id", "block_id"))}
    b = neighbours(ordered, ["document_id"], "ordinal", wanted)
    side = lambda n: F.when((F.col(f"{n}_type") == "caption") & F.col(f"{n}_page").eqNullSafe(F.col("page")), F.col(f"{n}_id"))
    return b.filter(F.col("block_type").isin("table", "figure")).select("document_id", F.col("block_id").alias("object_block"), F.coalesce(side("a"), side("b")).alias("caption_block")).filter("caption_block is not null")


def pack(rows: DataFrame, group: list[str], order: list[str], size: str, limits: Limits, joint: int = 2) -> DataFrame:
    """``rows`` with ``pack``: rows packed greedily in order, numbered from 0 in a group.

    A pack is closed before a row that would take it over the soft limit, if
    it holds the least already, or over the hard limit. ``joint`` characters
    stand between rows. Rows of null size count 0; a row over the hard limit
    is a pack by itself. What a pack holds depends on where the one before it
    ended, so this is a scan, streamed by group.
    """

    def step(state, row):
        n = row[size] or 0
        if state is None:
            return (0, n), {"pack": 0}
        k, total = state
        more = total + joint + n
        if more > limits.hard or (more > limits.soft and total >= limits.least):
            return (k + 1, n), {"pack": k + 1}
        return (k, more), {"pack": k}

    return fold(rows, group, order, step, "pack int")


def atoms(ordered: DataFrame) -> DataFrame:
    """``ordered`` blocks with ``atom``: blocks that must stay together share a number.

    A table, figure or formula takes the caption before or after it, the
    explaining paragraph after it and the one heading or paragraph before it,
    all of the same section and page; any other block is an atom by itself.
    Each block needs only the two blocks before it and the one after it, which
    are looked up by stretches of positions, so no document is a task.
    """
    g = ["document_id"]
    sides = {"b2": -2, "b1": -1, "a1": 1}
    b = neighbours(ordered, g, "ordinal", {f"{n}_{short}": (c, step) for n, step in sides.items() for short, c in (("type", "block_type"), ("section", "section_id"), ("page", "page"))})
    near = lambda n: F.col(f"{n}_section").eqNullSafe(F.col("section_id")) & F.col(f"{n}_page").eqNullSafe(F.col("page"))
    main = lambda t: t.isin("table", "figure", "formula")
    is_main, kind = main(F.col("block_type")), F.col("block_type")
    after_main = main(F.col("b1_type")) & near("b1")
    after_two = main(F.col("b2_type")) & near("b2") & near("b1") & (F.col("b1_type") == "caption")
    joins_back = F.when(is_main, F.coalesce((F.col("b1_type") == "caption") & near("b1") | (F.col("b1_type").isin("heading", "paragraph")) & near("b1"), F.lit(False)))
    joins_back = joins_back.when(kind == "caption", F.coalesce(after_main, F.lit(False))).when(kind == "paragraph", F.coalesce((after_main | after_two) & ~(F.coalesce(main(F.col("a1_type")), F.lit(False)) & F.coalesce(near("a1"), F.lit(False))), F.lit(False))).otherwise(F.lit(False))
    return running(b.withColumn("_new", (~joins_back).cast("int")), g, "ordinal", F.col("_new"), "atom").select(*ordered.columns, "atom")


def chunk_members(ordered: DataFrame, limits: Limits) -> DataFrame:
    """``document_id, block_id, ordinal, page, unit, pack``: the chunk of every block.

    ``ordered``: blocks with ``ordinal`` and ``size`` (characters of the text),
    without the text, which need not move for this. Units are packed by
    themselves. The units are written to the checkpoint folder once.
    """
    units = cut_lineage(structural_units(ordered).select("document_id", "block_id", "ordinal", "page", "size", "unit"))
    return pack(units, ["document_id", "unit"], ["ordinal"], "size", limits).drop("size")


def chunk_table(members: DataFrame, texts: DataFrame) -> DataFrame:
    """``document_id, unit, pack, blocks, text, characters, first_page, last_page`` of every chunk.

    ``texts``: ``document_id, block_id, text``. Blocks without text are left
    out of the text, not of the chunk; a chunk is bounded by its limits.
    """
    row = F.struct("ordinal", "block_id", "text")
    c = members.join(texts, ["document_id", "block_id"]).groupBy("document_id", "unit", "pack").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    text = F.array_join(F.filter(F.transform("rows", lambda x: F.trim(x["text"])), lambda t: t != ""), "\n\n")
    return c.select("document_id", "unit", "pack", F.col("rows.block_id").alias("blocks"), text.alias("text"), F.length(text).alias("characters"), "first_page", "last_page")


def duplicate_chunks(chunks: DataFrame, text: str = "text") -> DataFrame:
    """``document_id, chunk_id, canonical_id``: every chunk whose normalised text an earlier chunk of its document has, and the first that has it.

    The first is the smallest by (index, id), found by an aggregate per
    (document, text hash). Empty texts are never duplicates.
    """
    c = chunks.filter(~X.blank(F.col(text))).select("document_id", "chunk_id", "chunk_index", X.text_hash(F.col(text)).alias("hash"))
    first = c.groupBy("document_id", "hash").agg(F.min(F.struct("chunk_index", "chunk_id")).alias("f"))
    return c.join(first, ["document_id", "hash"]).filter(F.col("f.chunk_id") != F.col("chunk_id")).select("document_id", "chunk_id", F.col("f.chunk_id").alias("canonical_id"))


def with_context(chunks: DataFrame, most: int, same_path: bool = True) -> DataFrame:
    """Chunks (``document_id, ordinal, text, path``) with the end of the previous and the start of the next one, by default only of the same section path."""
    b = neighbours(chunks, ["document_id"], "ordinal", {"_before": ("text", -1), "_before_path": ("path", -1), "_after": ("text", 1), "_after_path": ("path", 1)})
    side = lambda n: F.col(f"_{n}_path").eqNullSafe(F.col("path")) if same_path else F.lit(True)
    return b.withColumns({
        "context_before": F.when(side("before"), X.trailing(X.normalize_text(F.coalesce("_before", F.lit(""))), most)),
        "context_after": F.when(side("after"), X.leading(X.normalize_text(F.coalesce("_after", F.lit(""))), most)),
    }).drop("_before", "_before_path", "_after", "_after_path")


def page_ranges(ordered: DataFrame, ancestors: DataFrame) -> DataFrame:
    """``document_id, section_id, first_page, last_page`` of a section and all below it: the pages of the first and last block, in reading order, that have one.

    ``ordered``: ``document_id, section_id, ordinal, page``; ``ancestors``:
    ``document_id, section_id, descendant_id``. Each section is reduced to its
    first and last block before its ancestors hear of them.
    """
    at = F.when(F.col("page").isNotNull(), F.struct("ordinal", "page"))
    own = ordered.filter("section_id is not null").groupBy("document_id", "section_id").agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    up = own.join(ancestors.select("document_id", F.col("section_id").alias("above"), F.col("descendant_id").alias("section_id")), ["document_id", "section_id"]).select("document_id", F.col("above").alias("section_id"), "lo", "hi")
    return own.unionByName(up).groupBy("document_id", "section_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("document_id", "section_id", F.col("lo.page").alias("first_page"), F.col("hi.page").alias("last_page"))


#: Levels up to which headings are resolved by running maxima, one for each level.
LEVELS = 64


def heading_stack(lines: DataFrame) -> DataFrame:
    """Headings with ``parent_ordinal``: the nearest heading before of a smaller level. ``lines``: ``document_id, ordinal, level``.

    The nearest one is the greatest ordinal before among all smaller levels,
    so it is a running maximum for each level that occurs, by stretches of the
    document. The driver gets the distinct levels; should there be more than
    ``LEVELS``, a streamed scan that keeps the open headings does the same. A
    heading without a level has no parent and is none.
    """
    found = sorted(r["level"] for r in lines.select("level").filter("level is not null").distinct().limit(LEVELS + 1).collect())
    if len(found) <= LEVELS:
        return last_by_level(lines, ["document_id"], "ordinal", "level", found, "parent_ordinal")

    def step(state, row):
        if row["level"] is None:
            return state, {"parent_ordinal": None}
        above = [x for x in state or [] if x[0] < row["level"]]
        return [*above, (row["level"], row["ordinal"])], {"parent_ordinal": above[-1][1] if above else None}

    return fold(lines, ["document_id"], ["ordinal"], step, "parent_ordinal bigint")


def boundary_lines(blocks: DataFrame, first: int = 4, last: int = 2, longest: int = 220) -> DataFrame:
    """``document_id, key, side, places``: short blocks among the first or last of a page that return on half of the document's pages or more, twice at least.

    ``blocks``: ``document_id, block_id, page, reading_order, size, key`` (key
    text; null for blocks that are too long anyway).
    """
    n = number(blocks, ["document_id", "page"], [], ["reading_order", "block_id"], "_n")
    sizes = blocks.groupBy("document_id", "page").agg(F.count(F.lit(1)).alias("_all"))
    b = n.join(sizes, ["document_id", "page"]).filter((F.col("size") < longest) & (F.col("key") != ""))
    sides = F.explode(F.array_compact(F.array(F.when(F.col("_n") <= first, F.lit("header")), F.when(F.col("_n") > F.col("_all") - last, F.lit("footer")))))
    seen = b.select("document_id", "page", "key", sides.alias("side")).distinct().groupBy("document_id", "key", "side").agg(F.count(F.lit(1)).alias("places"))
    pages = blocks.filter("page is not null").groupBy("document_id").agg(F.countDistinct("page").alias("_pages"))
    enough = F.greatest(F.lit(2), F.floor((F.col("_pages") + 1) / 2))
    return seen.join(pages, "document_id").filter(F.col("places") >= enough).drop("_pages")


def adjacent_duplicates(ordered: DataFrame) -> DataFrame:
    """Blocks that repeat the key text of the block before them on their page: ``document_id, block_id``.

    ``ordered``: ``document_id, block_id, page, ordinal, key`` (key text or a
    hash of it; null for blocks without text, which stand between no others).
    """
    b = cut_lineage(number(ordered.filter("key is not null"), ["document_id"], ["page"], ["ordinal"], "n"))
    back = neighbours(b, ["document_id"], "n", {"_key": ("key", -1), "_page": ("page", -1)})
    return back.filter(F.col("_page").eqNullSafe(F.col("page")) & (F.col("_key") == F.col("key"))).select("document_id", "block_id")


def spans(blocks: DataFrame, group: list[str], coarse: list[str], order: list[str], text: str = "text", joint: int = 2) -> DataFrame:
    """Blocks with ``start`` and ``end``: the place of each in the text of its group, blocks joined by ``joint`` characters; null texts have no width and no joint."""
    n = number(blocks, group, coarse, order)
    size = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.length(text) + joint)
    return running(n, group, "ordinal", size, "start", whole=False).withColumn("end", F.col("start") + F.coalesce(F.length(text), F.lit(0)))


def rendered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, text``: blocks (``at, block_type, text``) of each key joined in order by blank lines; a caption that was given already is left out.

    Repeated captions are found by the first position of each (key, caption),
    an aggregate; a key's blocks are as few as fit its limits. Null and blank
    texts are left out.
    """
    t = F.trim(F.coalesce("text", F.lit("")))
    r = rows.select(*keys, "at", "block_type", t.alias("text")).filter("text <> ''").withColumn("caption", F.when(F.col("block_type") == "caption", F.unhex(F.md5(X.key_text(F.col("text"))))))
    first = r.filter("caption is not null").groupBy(*keys, "caption").agg(F.min("at").alias("first_at"))
    kept = r.join(first, [*keys, "caption"], "left").filter("caption is null or at = first_at")
    return kept.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def segments(ordered: DataFrame, group: list[str], ordinal: str, head: str, size: str, most: int, joint: int = 2) -> DataFrame:
    """``ordered`` with ``part`` and ``segment``: a new segment begins at a heading (column ``head`` true) and before a row that would take it over ``most`` characters.

    ``part`` counts the headings so far (a running sum by stretches) and
    ``segment`` the segments of a part from 0. Only within a part does a
    segment depend on the one before it; parts are streamed apart. Null heads
    are no headings, null sizes count 0.
    """
    parts = running(ordered, group, ordinal, F.coalesce(F.col(head), F.lit(False)).cast("bigint"), "part")

    def step(state, row):
        n = row[size] or 0
        if state is None:
            return (0, n), {"segment": 0}
        k, total = state
        more = total + joint + n
        return ((k + 1, n), {"segment": k + 1}) if more > most else ((k, more), {"segment": k})

    return fold(parts, [*group, "part"], [ordinal], step, "segment int")


def merged_segments(segments: DataFrame, group: list[str], ordinal: str, able: str, size: str, most: int) -> DataFrame:
    """``segments`` with ``section`` from 0: neighbours that are alike in ``able`` are one while they fit into ``most`` characters.

    A streamed scan over segments, of which there are as many as headings or
    sizes made. Null sizes count 0; nulls in ``able`` are alike.
    """

    def step(state, row):
        n = row[size] or 0
        if state is None:
            return (0, n, row[able]), {"section": 0}
        k, total, kind = state
        if row[able] == kind and total + n <= most:
            return (k, total + n, kind), {"section": k}
        return (k + 1, n, row[able]), {"section": k + 1}

    return fold(segments, group, [ordinal], step, "section int")


def render_table(text: Column) -> Column:
    """Lines of cells parted by ``|`` as a full matrix: cells trimmed, short rows filled, joined by `` | ``."""
    rows = F.transform(F.filter(F.split(text, "\n"), lambda r: F.trim(r) != ""), lambda r: F.transform(F.split(r, r"\|"), lambda c: F.trim(c)))
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | ")), "\n")


def split_paragraph(df: DataFrame, text: str, most: int, into: str = "fragment") -> DataFrame:
    """``df`` with ``fragment_no`` (from 1) and ``fragment``: sentences and lines of ``text`` packed up to ``most`` characters; a longer sentence is packed by words.

    All in the JVM: the pieces are folded by ``aggregate``. A word longer than
    ``most`` stays whole. Empty and null texts have no fragments.
    """
    parts = F.filter(F.split(F.trim(X.line_ends(F.col(text))), r"(?<=[.!?])\s+|\n+"), lambda x: x != "")
    pieces = F.flatten(F.transform(parts, lambda s, i: F.when(F.length(s) > most, F.transform(F.split(s, " "), lambda w: F.struct((i + 1).alias("word"), w.alias("t")))).otherwise(F.array(F.struct(F.lit(0).alias("word"), s.alias("t"))))))
    # closed fragments, the open one, and the long sentence it is made of (0 for whole sentences), which it never outlasts
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("word"))

    def merge(acc, x):
        joined = F.trim(F.concat(acc["now"], F.lit(" "), x["t"]))
        close = (acc["now"] != "") & ((F.length(joined) > most) | (acc["word"] != x["word"]))
        return F.struct(
            F.when(close, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"),
            F.when(close, x["t"]).otherwise(joined).alias("now"),
            x["word"].alias("word"),
        )

    whole = F.aggregate(pieces, start, merge, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])))
    return df.select("*", F.posexplode(whole).alias("fragment_no", into)).withColumn("fragment_no", F.col("fragment_no") + 1)
