"""Queries of the training-text operators, over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.labels import clean_path, language_code, source_of
from lectern.llm import boilerplate, lookalike, mixture, pairs, reading, scans, splitting, tokens
from lectern.session import broadcast_if_small, cut_lineage
from lectern.sources.tables import latest, latest_texts, table


#: So many ids of scanned documents at most (about 10 MB) are broadcast to tell scans from other texts; more are joined by shuffle.
SCANNED_IDS = 100_000


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["document_id", "transformation_id"]
    rows = latest(table(spark, folder, "model_transformations"), keys, "ingested_at", [*keys, "original_text", "reconstructed_text"])
    return pairs.defective_pairs(rows, latest(table(spark, folder, "normalized_documents"), ["document_id"], "ingested_at", ["document_id", "language"]))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.one_defect(_pairs(spark, folder))


def p1_labels(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("document_id", "transformation_id", F.explode("labels").alias("x")).select("document_id", "transformation_id", "x.defect", "x.posterior")


def _scans(spark: SparkSession, folder: str) -> scans.ScanText:
    """Raw blocks and the blocks of likely scans as items; a missing title is taken from the document's first page."""
    about = latest(table(spark, folder, "normalized_documents"), ["document_id"], "ingested_at", ["document_id", "title", "classification"])
    raw = table(spark, folder, "raw_blocks").select("document_id", F.col("raw_block_id").alias("item_id"), F.col("location_number").alias("page"), F.col("block_ordinal").alias("place"), F.lit(None).cast("double").alias("top"), "text", F.lit("raw").alias("origin")).distinct()
    scanned = broadcast_if_small(cut_lineage(about.filter("classification = 'likely_scanned'").select("document_id")), SCANNED_IDS)
    every = table(spark, folder, "blocks").select("document_id", "block_id", "page", "reading_order", "bbox_top", "text", "ingested_at")
    mine = latest(every.join(scanned, "document_id", "left_semi"), ["document_id", "block_id"], "ingested_at", ["document_id", "block_id", "page", "reading_order", "bbox_top", "text"])
    items = cut_lineage(raw.unionByName(mine.select("document_id", F.col("block_id").alias("item_id"), "page", F.col("reading_order").alias("place"), F.col("bbox_top").alias("top"), "text", F.lit("block").alias("origin"))))
    first = items.filter((F.col("page") == 1) & (F.trim("text") != "")).groupBy("document_id").agg(F.min_by("text", F.struct("place", "item_id")).alias("first"))
    short = F.when((F.length("first") < 150) & ~F.col("first").rlike(r"[.!?]\s|\n"), F.col("first"))
    titles = first.join(about.select("document_id", "title"), "document_id", "full").select("document_id", F.coalesce("title", short).alias("title"))
    return scans.scan_text(items, titles, every.select("document_id", "text").join(scanned, "document_id", "left_anti"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scans(spark, folder).noise()


def p2_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return _scans(spark, folder).paragraphs()


def _oversized(spark: SparkSession, folder: str) -> DataFrame:
    """The latest delivery of every chunk that is longer than its limit, with its configuration.

    Deliveries of a chunk have the same text, so the lengths are tested before
    the deliveries are compared and only oversized texts are shuffled.
    """
    limits = table(spark, folder, "chunking_configurations").select("config_id", "hard_max_characters", "maximum_context_characters_per_side")
    c = table(spark, folder, "chunks").select("document_id", "chunk_id", "text", "section_path", "config_id", "generated_at").join(limits, "config_id")
    return latest(c.filter(F.char_length("text") > F.col("hard_max_characters")), ["document_id", "chunk_id"], "generated_at")


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_oversized(_oversized(spark, folder), ["document_id", "chunk_id"], "text", "hard_max_characters", "maximum_context_characters_per_side", "section_path")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_pieces(spark, folder).filter("part_no = 1 and n_parts > 1").select("document_id", "chunk_id")


def p3_checks(spark: SparkSession, folder: str) -> DataFrame:
    """``document_id, chunk_id, whole, within, shared``: whether a chunk's pieces make up its text, keep its limit, and share no more than they may."""
    keys = ["document_id", "chunk_id"]
    o = cut_lineage(_oversized(spark, folder))
    pieces = splitting.split_oversized(o, keys, "text", "hard_max_characters", "maximum_context_characters_per_side", "section_path")
    row = F.struct("part_no", F.expr("substr(part, core_start - start + 1)").alias("core"))
    made = pieces.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["core"]), "").alias("made"), F.max(F.length("part")).alias("most"), F.max(F.col("core_start") - F.col("start")).alias("most_shared"))
    fits = lambda a, b: F.col(a) <= F.coalesce(F.col(b), F.lit(0))
    return o.join(made, keys, "left").select(*keys, (F.col("made") == F.col("text")).alias("whole"), fits("most", "hard_max_characters").alias("within"), fits("most_shared", "maximum_context_characters_per_side").alias("shared"))


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    """``document_id, source`` of the documents that are not likely scans."""
    d = latest(table(spark, folder, "normalized_documents"), ["document_id"], "ingested_at", ["document_id", "source_relative_path", "classification"])
    return d.filter(~F.col("classification").eqNullSafe("likely_scanned")).select("document_id", source_of(F.col("source_relative_path")).alias("source"))


def _boilerplate(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The occurrences of boilerplate lines and the boilerplate blocks."""
    sources = _sources(spark, folder)
    columns = ["document_id", "block_id", "block_type", "page", "reading_order", "text"]
    b = table(spark, folder, "blocks").select(*columns).filter(~F.coalesce(F.col("block_type"), F.lit("")).isin("title", "heading"))
    return boilerplate.boilerplate(b, sources)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _boilerplate(spark, folder)[0].select("document_id", "block_id", F.col("line_no").cast("int").alias("line_no"))


def p4_texts(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.without_lines(blocks(spark, folder, "text"), _boilerplate(spark, folder)[0])


def p4_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The boilerplate blocks: how many lines each holds and in how many documents and pieces it stands."""
    return _boilerplate(spark, folder)[1].select("source", "lines", "documents", "pieces")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries of a block have the same text and excerpt, so literal containment is tested before the deliveries are compared and only rows that fail it are shuffled."""
    b = table(spark, folder, "blocks").select("document_id", "block_id", "text", "source_excerpt", "ingested_at")
    keys = ["document_id", "block_id"]
    return lookalike.disguised_excerpts(latest(b.filter(lookalike.not_literal("text", "source_excerpt")), keys, "ingested_at"), keys, "text", "source_excerpt")


def p6_texts(spark: SparkSession, folder: str) -> DataFrame:
    b = blocks(spark, folder, "text", "source_excerpt")
    return lookalike.one_form(b, ["text", "source_excerpt"]).select("document_id", "block_id", F.col("text_form"), F.col("source_excerpt_form"))


def _items(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks and documents as items of one shape, with the hash of their text; each slice under one name. The texts do not move."""
    lang = latest(table(spark, folder, "normalized_documents"), ["document_id"], "ingested_at", ["document_id", "language"])
    hashed = table(spark, folder, "chunks").select("chunk_id", "document_id", tokens.text_key().alias("text_hash"), "source_relative_path", "document_type", "generated_at")
    chunks = latest(hashed, ["chunk_id"], "generated_at").join(lang, "document_id", "left")
    docs = table(spark, folder, "documents").select("doc_id", tokens.text_key().alias("text_hash"), "source", "lang", "domain", "document_type")
    shape = lambda df, kind, key, source, language, domain, kind_of: df.select(
        F.lit(kind).alias("item_kind"), key.cast("string").alias("item_id"), "text_hash", source.alias("source"), language_code(language).alias("language"), domain.alias("domain"), kind_of.alias("document_type")
    )
    none = F.lit(None).cast("string")
    return shape(chunks, "chunk", F.col("chunk_id"), source_of(F.col("source_relative_path")), F.col("language"), none, F.lower(F.trim("document_type"))).unionByName(
        shape(docs, "document", F.col("doc_id"), clean_path(F.col("source")), F.col("lang"), F.lower(F.trim("domain")), F.lower(F.trim("document_type")))
    )


def _token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every distinct text of chunks and documents; a text that stands in both is tokenized once."""
    return tokens.distinct_counts(table(spark, folder, "chunks").select("text").unionByName(table(spark, folder, "documents").select("text")))


def p7_totals(spark: SparkSession, folder: str) -> DataFrame:
    dims = {d: d for d in ("source", "language", "domain", "document_type")}
    return tokens.slice_totals(_items(spark, folder), _token_counts(spark, folder), dims, ["item_kind"]).filter("item_kind <> 'chunk' or dimension <> 'domain'")


def p7_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of every combination of source, language and domain (of chunks the document type)."""
    items = _items(spark, folder).withColumn("domain", F.when(F.col("item_kind") == "chunk", F.col("document_type")).otherwise(F.col("domain")))
    return tokens.cell_totals(items, _token_counts(spark, folder), ["item_kind", "source", "language", "domain"])


def p7_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _items(spark, folder).select("item_kind", "item_id", "text_hash").join(_token_counts(spark, folder), "text_hash").select("item_kind", "item_id", "n_tokens")


def p7_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The items and distinct texts of the slices of ``p7_totals``, which SQL can count too."""
    return p7_totals(spark, folder).select("item_kind", "dimension", "slice", "items", "texts")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, folder, "documents"))


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", clean_path(F.col("source")).alias("source"))
    return mixture.mix_sources(docs, table(spark, folder, "mixture_targets"))


def p9_selection(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.actual_shares(_mixed(spark, folder), table(spark, folder, "mixture_targets"))


def p9_limits(spark: SparkSession, folder: str) -> DataFrame:
    """``mix_name, source, repeats_kept, shares_whole``: whether no text is used too often and the shares of a mix add up to one."""
    s = p9_shares(spark, folder)
    whole = s.groupBy("mix_name").agg((F.abs(F.sum("actual_share") - 1) < 1e-9).alias("shares_whole"))
    return s.join(whole, "mix_name").select("mix_name", "source", (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"), "shares_whole")


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    return reading.reading_levels(table(spark, folder, "documents"), table(spark, folder, "level_examples"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder).filter("n_words >= 30").select("doc_id", "reading_level")


def p10_levels(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder)


def blocks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The latest delivery of every block, with the named columns."""
    keys = ["document_id", "block_id"]
    return latest_texts(table(spark, folder, "blocks").select(*keys, *columns, "ingested_at"), keys, "ingested_at", [*keys, *columns])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_labels, p2_found, p2_paragraphs, p3_found, p3_pieces, p3_checks, p4_found, p4_texts, p4_blocks, p6_found, p6_texts, p7_totals, p7_cells, p7_tokens, p7_counts, p8_ids, p9_selection, p9_shares, p9_limits, p10_found, p10_levels)}
