"""Items of a parser's tree to rows of the common model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.ordering import number

#: The block type of each label of a parser; items of other labels are no blocks.
BLOCK_TYPES = {
    "title": "title", "section_header": "heading", "paragraph": "paragraph", "text": "paragraph", "list_item": "list_item", "table": "table", "picture": "figure", "chart": "figure", "caption": "caption", "formula": "formula", "code": "code", "footnote": "footnote", "page_header": "header", "page_footer": "footer",
}

#: What a location is in each type of document.
LOCATION_TYPES = {"pdf": "page", "powerpoint": "slide", "word": "document"}


def _known(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for x in values.items() for v in x]), key)


def block_type(label: Column) -> Column:
    """The block type of a label; null for labels that name no block."""
    return _known(BLOCK_TYPES, label)


def location_type(document_type: Column) -> Column:
    """``page``, ``slide`` or ``document``; null for unknown types."""
    return _known(LOCATION_TYPES, document_type)


def padded(kind: str, n: Column) -> Column:
    """``block-000012``: an id in the order of its number."""
    return F.format_string(f"{kind}-%06d", n.cast("bigint"))


def reference(path: Column, kind: Column, page: Column, block: Column, excerpt: Column) -> Column:
    """The source reference of a block; a whole document has no page."""
    return F.struct(path.alias("source_relative_path"), kind.alias("location_type"), F.when(kind != "document", page).alias("page"), block.alias("block_id"), excerpt.alias("excerpt"))


def item_rows(items: DataFrame) -> DataFrame:
    """``document_id, block_id, block_type, ordinal, page, top, caption, text`` of the items that are blocks.

    ``items``: ``document_id, place, label, text, document_type, prov
    array<struct<page, top>>, captions array<string>, cells array<struct<row,
    col, text>>, n_rows, n_cols``. Page and top come from the first
    provenance, none in word documents; the first caption counts, if it says
    anything; a table's text is its matrix. Unknown labels are dropped before
    the rest is numbered.
    """
    kept = items.withColumn("block_type", block_type(F.col("label"))).filter("block_type is not null")
    kept = number(kept.withColumn("_stretch", F.floor(F.col("place") / 1000)), ["document_id"], ["_stretch"], ["place"])
    first = F.when(F.col("document_type") != "word", F.get("prov", F.lit(0)))
    caption = F.nullif(F.get("captions", F.lit(0)), F.lit(""))
    body = F.when(F.col("block_type") == "table", matrix("cells", "n_rows", "n_cols")).otherwise(F.col("text"))
    return kept.select("document_id", padded("block", F.col("ordinal")).alias("block_id"), "block_type", "ordinal", first["page"].alias("page"), first["top"].alias("top"), caption.alias("caption"), body.alias("text"))


def matrix(cells: str, n_rows: str, n_cols: str, caption: Column | None = None) -> Column:
    """A table's cells as lines joined by `` | ``, under its caption if there is one.

    Cells beyond the table's size are left out; of cells at one place the last
    counts; places without a cell are empty.
    """
    at = lambda i, j: F.filter(F.coalesce(F.col(cells), F.array().cast("array<struct<row:int,col:int,text:string>>")), lambda c: (c["row"] == i) & (c["col"] == j))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    line = lambda i: F.array_join(F.transform(upto(n_cols), lambda j: F.coalesce(F.try_element_at(at(i, j), F.lit(-1))["text"], F.lit(""))), " | ")
    rows = F.transform(upto(n_rows), line)
    return F.array_join(rows if caption is None else F.concat(F.when(F.coalesce(caption, F.lit("")) != "", F.array(caption)).otherwise(F.array().cast("array<string>")), rows), "\n")


def text_candidates(blocks: DataFrame) -> DataFrame:
    """``document_id, page, ordinal, block_id, text, key``: text blocks of each page that say anything, stripped, in reading order, with the form in which they are compared.

    ``blocks``: ``document_id, page, place, block_id, text``.
    """
    b = blocks.select("document_id", "page", "place", "block_id", X.strip(F.col("text")).alias("text")).withColumn("key", X.key_text(F.col("text"))).filter("key <> ''")
    return number(b, ["document_id", "page"], [], ["place", "block_id"]).select("document_id", "page", "ordinal", "block_id", "text", "key")
