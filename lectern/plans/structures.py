"""Queries on blocks, sections and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import building
from lectern.operators import structure as S
from lectern.operators.association import associate
from lectern.operators.cleaning import echoes
from lectern.operators.hierarchy import hierarchy
from lectern.operators.ordering import neighbours, number
from lectern.plans.hierarchies import _TREE
from lectern.plans.texts import _fold, _key, _normal
from lectern.session import broadcast_if_small, cut_lineage
from lectern.sources import exports
from lectern.sources.sinks import markdown
from lectern.sources.tables import latest, latest_texts, table

#: Sizes of the flagship query.
FLAGSHIP = S.Limits(soft=1500, hard=2500, least=200)

#: Ids of documents with tables or assets that are broadcast at most.
OBJECT_DOCUMENTS = 200_000

_COLUMNS = ["block_type", "text", "page", "reading_order", "section_id", "location_type", "bbox_top", "table_id", "asset_id"]


def _blocks(spark: SparkSession, folder: str, *columns: str | Column) -> DataFrame:
    """The latest delivery of every block with the named columns; computed ones are made before anything moves."""
    keys = ["document_id", "block_id"]
    pick = latest_texts if not columns or any(isinstance(c, str) and c == "text" for c in columns) else latest
    return pick(table(spark, folder, "blocks").select(*keys, *(columns or _COLUMNS), "ingested_at"), keys, "ingested_at").drop("ingested_at")


def _ordered(spark: SparkSession, folder: str, *columns: str | Column) -> DataFrame:
    """Blocks in reading order, without their texts, kept at the checkpoint folder since they are read several times."""
    return cut_lineage(S.reading_order(_blocks(spark, folder, "page", "reading_order", *columns)))


def _chunks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    keys = ["document_id", "chunk_id"]
    pick = latest_texts if "text" in columns or "refs" in columns else latest
    return pick(table(spark, folder, "chunks").select(*keys, *columns, "generated_at"), keys, "generated_at", [*keys, *columns])


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "raw_blocks").select("document_id", "raw_block_id", "location_number", "block_ordinal", "text", "raw_start", "raw_end").distinct()


def reading_order(spark: SparkSession, folder: str) -> DataFrame:
    return S.reading_order(_blocks(spark, folder, "page", "reading_order")).select("document_id", "block_id", "ordinal")


def repeated_furniture(spark: SparkSession, folder: str) -> DataFrame:
    return S.repeated_furniture(_blocks(spark, folder, "page", S.furniture_key().alias("furniture")))


def structural_units(spark: SparkSession, folder: str) -> DataFrame:
    return S.structural_units(_ordered(spark, folder, "block_type", "section_id", "location_type")).select("document_id", "block_id", "scope", F.col("unit").cast("bigint").alias("unit"))


def greedy_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: drop repeated furniture, order the blocks, cut units, pack them into chunks; texts join at the end."""
    size = F.length(F.coalesce("text", F.lit(""))).alias("size")
    b = cut_lineage(_blocks(spark, folder, "page", "reading_order", "block_type", "section_id", "location_type", size, S.furniture_key().alias("furniture")))
    kept = b.join(S.repeated_furniture(b).select("document_id", "block_id"), ["document_id", "block_id"], "left_anti").drop("furniture")
    c = S.chunk_table(S.chunk_members(cut_lineage(S.reading_order(kept)), FLAGSHIP), _blocks(spark, folder, "text"))
    return c.select("document_id", F.col("unit").cast("bigint").alias("unit"), F.col("pack").cast("bigint").alias("pack"), F.size("blocks").cast("bigint").alias("blocks"), F.sha2("text", 256).alias("text_hash"), F.col("characters").cast("bigint").alias("characters"), X.token_estimate(F.col("characters")).alias("tokens"), "first_page", "last_page")


def _built(spark: SparkSession, folder: str) -> DataFrame:
    b = cut_lineage(_blocks(spark, folder, "page", "reading_order", "block_type", "section_id", "location_type", F.col("text").isNotNull().alias("has_text"), S.furniture_key().alias("furniture")))
    kept = b.join(S.repeated_furniture(b).select("document_id", "block_id"), ["document_id", "block_id"], "left_anti").drop("furniture")
    openings = b.groupBy("document_id").agg(F.min(F.struct("reading_order", "page", "block_id")).alias("x")).select("document_id", "x.block_id")
    text = F.when((F.col("block_type") == "table") & (F.trim("text") != ""), S.render_table(F.col("text"))).otherwise(F.col("text")).alias("text")
    rows = cut_lineage(latest(table(spark, folder, "sections"), ["document_id", "section_id"], "ingested_at", ["document_id", "section_id", "parent_section_id", "title", "level"]))
    paths = hierarchy(rows, "document_id", "section_id", "parent_section_id", "title").nodes.select("document_id", "section_id", "path")
    sections = rows.select("document_id", "section_id", "level").join(paths, ["document_id", "section_id"], "left")
    return building.build(cut_lineage(S.reading_order(kept)), openings, _blocks(spark, folder, "block_type", "text").select("document_id", "block_id", text), sections, FLAGSHIP)


def built_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks as chunks of typed atoms, runs and packs (see :mod:`lectern.operators.building`), in the sizes of the flagship."""
    size = F.length("text").cast("bigint")
    return _built(spark, folder).select(
        "document_id", "chunk_index", "chunk_id", "chunk_type", "unit", F.array_join("path", " / ", "-").alias("path"), "confidence", F.size("blocks").cast("bigint").alias("blocks"), "text_hash", size.alias("characters"), X.token_estimate(size).alias("tokens"), "location_type", "first_page", "last_page",
        F.array_join("warnings", ",").alias("warnings"),
    )


def built_checks(spark: SparkSession, folder: str) -> DataFrame:
    """``document_id, blocks, in_order, within, numbered``: the distinct blocks that a document's chunks hold, and whether these stand in reading order, keep the limit or are warned of, and are numbered without a gap."""
    c = cut_lineage(_built(spark, folder))
    g = c.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.max("chunk_index").alias("last"), F.bool_and((F.length("text") <= FLAGSHIP.hard) | (F.size("warnings") > 0)).alias("within"))
    order = S.reading_order(_blocks(spark, folder, "page", "reading_order")).select("document_id", "block_id", "ordinal")
    each = c.select("document_id", "chunk_index", F.posexplode("blocks").alias("at", "block_id")).join(order, ["document_id", "block_id"])
    ends = each.groupBy("document_id", "chunk_index").agg(F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.min(F.struct("at", "ordinal")).alias("first"), F.max(F.struct("at", "ordinal")).alias("final"), F.countDistinct("block_id").alias("blocks"))
    nxt = neighbours(ends.withColumn("pos", F.col("chunk_index") + 1), ["document_id"], "pos", {"next_lo": ("lo", 1)})
    fine = (F.col("first.ordinal") == F.col("lo")) & (F.col("final.ordinal") == F.col("hi")) & (F.col("next_lo").isNull() | (F.col("next_lo") >= F.col("hi")))
    ordered = nxt.groupBy("document_id").agg(F.bool_and(fine).alias("in_order"))
    held = each.select("document_id", "block_id").distinct().groupBy("document_id").agg(F.count(F.lit(1)).alias("blocks"))
    return g.join(ordered, "document_id").join(held, "document_id").select("document_id", "blocks", "in_order", "within", (F.col("last") == F.col("n") - 1).alias("numbered"))


def block_atoms(spark: SparkSession, folder: str) -> DataFrame:
    a = S.atoms(_ordered(spark, folder, "block_type", "section_id"))
    return a.groupBy("document_id", F.col("atom").cast("bigint").alias("atom")).agg(F.count(F.lit(1)).alias("blocks"), F.min("block_id").alias("first_block"))


def chunk_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return S.duplicate_chunks(_chunks(spark, folder, "chunk_index", "text"))


def neighbor_context(spark: SparkSession, folder: str) -> DataFrame:
    c = _chunks(spark, folder, "chunk_index", "text", "section_path").withColumn("path", F.array_join("section_path", "\u0001"))
    n = cut_lineage(number(c.withColumn("stretch", F.floor(F.col("chunk_index") / 1000)), ["document_id"], ["stretch"], ["chunk_index", "chunk_id"]))
    return S.with_context(n.select("document_id", "chunk_id", "ordinal", "text", "path"), 120).select("document_id", "chunk_id", "context_before", "context_after")


def chunk_stats(spark: SparkSession, folder: str) -> DataFrame:
    c = _chunks(spark, folder, "chunk_type", "text", "eligible", "refs").withColumn("n", F.length(F.coalesce("text", F.lit(""))))
    stats = c.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("chunk_type") == "section").alias("sections"), F.count_if("eligible").alias("eligible"), F.min("n").cast("bigint").alias("least"), F.max("n").cast("bigint").alias("most"),
        F.round(F.avg("n"), 4).alias("mean"), F.sum(X.token_estimate(F.col("n"))).cast("bigint").alias("tokens"),
    )
    pages = c.select("document_id", F.explode("refs").alias("r")).groupBy("document_id").agg(F.countDistinct("r.page").alias("pages"))
    docs = table(spark, folder, "normalized_documents").select("document_id").distinct()
    zero = [F.coalesce(k, F.lit(0)).alias(k) for k in ("chunks", "sections", "eligible", "least", "most")]
    return docs.join(stats, "document_id", "left").join(pages, "document_id", "left").select("document_id", *zero, F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("pages", F.lit(0)).alias("pages"))


def page_ranges(spark: SparkSession, folder: str) -> DataFrame:
    rows = latest(table(spark, folder, "sections"), ["document_id", "section_id"], "ingested_at", ["document_id", "section_id", "parent_section_id", "title"])
    return S.page_ranges(S.reading_order(_blocks(spark, folder, "section_id", "page", "reading_order")), hierarchy(rows, "document_id", "section_id", "parent_section_id", "title").descendants())


def heading_stack(spark: SparkSession, folder: str) -> DataFrame:
    rows = latest(table(spark, folder, "sections"), ["document_id", "section_id"], "ingested_at", ["document_id", "section_id", "level"]).filter("level is not null")
    n = number(rows.withColumn("start", F.left("section_id", F.lit(12))), ["document_id"], ["start"], ["section_id"])
    return S.heading_stack(n).select("document_id", "section_id", "ordinal", "parent_ordinal")


def boundary_lines(spark: SparkSession, folder: str) -> DataFrame:
    size = F.length("text")
    b = _blocks(spark, folder, "page", "reading_order", size.alias("size"), F.when(size < 220, X.key_text(F.col("text"))).alias("key"))
    return S.boundary_lines(b.filter("size is not null"))


def adjacent_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    key = X.key_text(F.col("text"))
    return S.adjacent_duplicates(_ordered(spark, folder, F.when(key != "", F.unhex(F.md5(key))).alias("key")))


def table_echoes(spark: SparkSession, folder: str) -> DataFrame:
    b = _blocks(spark, folder, "page", "reading_order", "text")
    at = F.row_number().over(Window.partitionBy("document_id", "page").orderBy("reading_order", "block_id")) - 1
    return echoes(b.filter(F.col("text") != "").withColumn("at", at))


def raw_spans(spark: SparkSession, folder: str) -> DataFrame:
    s = S.spans(_raw(spark, folder), ["document_id"], ["location_number"], ["block_ordinal", "raw_block_id"])
    return s.select("document_id", "raw_block_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


def rendered_tables(spark: SparkSession, folder: str) -> DataFrame:
    t = _blocks(spark, folder, "block_type", "text").filter("block_type = 'table' and text is not null and trim(text) <> ''")
    return t.select("document_id", "block_id", S.render_table(F.col("text")).alias("rendered"))


def oversize_split(spark: SparkSession, folder: str) -> DataFrame:
    c = _chunks(spark, folder, "text").filter(F.length("text") > 1000)
    return S.split_paragraph(c.select("document_id", "chunk_id", "text"), "text", 1000).select("document_id", "chunk_id", F.col("fragment_no").cast("bigint").alias("fragment_no"), F.length("fragment").cast("bigint").alias("characters"), F.md5("fragment").alias("fragment"))


def association_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Tables and assets with their chunks; only documents that have any are looked at, and their blocks are kept once, without texts."""
    raw = table(spark, folder, "blocks")
    own = broadcast_if_small(cut_lineage(raw.filter("table_id is not null or asset_id is not null").select("document_id").distinct()), OBJECT_DOCUMENTS)
    columns = ["block_type", "page", "reading_order", "bbox_top", "table_id", "asset_id"]
    key = F.nullif(X.normalize_text(F.col("text")), F.lit(""))
    keyed = raw.join(own, "document_id", "left_semi").select("document_id", "block_id", *columns, F.unhex(F.sha2(key, 256)).alias("key"), "ingested_at")
    b = cut_lineage(S.reading_order(latest(keyed, ["document_id", "block_id"], "ingested_at", ["document_id", "block_id", *columns, "key"])))
    carried = b.filter("table_id is not null or asset_id is not null").select("document_id", F.coalesce("table_id", "asset_id").alias("object_id"), F.col("table_id").isNull().alias("is_asset"), "block_id", "page", "ordinal", F.col("bbox_top").alias("top"))
    heads = carried.groupBy("document_id", "object_id").agg(F.min(F.struct("ordinal", "block_id", "page", "top", "is_asset")).alias("x")).select("document_id", "object_id", "x.*")
    beside = S.captions_of(b).withColumnsRenamed({"object_block": "block_id", "caption_block": "caption_id"})
    spoken = b.filter("block_type = 'caption'").select("document_id", F.col("block_id").alias("caption_id"), F.col("key").alias("caption"))
    objects = cut_lineage(heads.join(beside.join(spoken, ["document_id", "caption_id"]).select("document_id", "block_id", "caption"), ["document_id", "block_id"], "left"))
    c = table(spark, folder, "chunks").join(own, "document_id", "left_semi").select("document_id", "chunk_id", "chunk_index", F.transform("refs", lambda r: F.struct(r["block_id"].alias("block_id"), r["page"].alias("page"))).alias("refs"), "generated_at")
    refs = cut_lineage(latest(c, ["document_id", "chunk_id"], "generated_at", ["document_id", "chunk_id", "chunk_index", "refs"]))
    chunks = refs.select("document_id", "chunk_id", F.array_min("refs.page").alias("first_page"), F.array_max("refs.page").alias("last_page"))
    members = refs.select("document_id", "chunk_id", "chunk_index", F.explode("refs.block_id").alias("block_id")).join(b.select("document_id", "block_id", F.col("bbox_top").alias("top"), "key"), ["document_id", "block_id"], "left")
    return associate(objects, carried.filter("is_asset").select("document_id", "object_id", "block_id"), chunks, cut_lineage(members))


def evidence_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Where each excerpt of a chunk stands in its text, looked for from the end of the one before (0: nowhere)."""
    c = _chunks(spark, folder, "text", "refs").filter("text is not null and size(refs) > 0")
    excerpts = F.filter(F.col("refs.excerpt"), lambda x: x.isNotNull() & (x != ""))
    folded = F.expr(
        "aggregate(filter(refs.excerpt, x -> x is not null and x <> ''), struct(1 as at, cast(array() as array<int>) as found),"
        " (acc, x) -> struct(if(locate(x, text, acc.at) = 0, acc.at, locate(x, text, acc.at) + char_length(x)) as at, array_append(acc.found, locate(x, text, acc.at)) as found), acc -> acc.found)"
    )
    f = c.select("document_id", "chunk_id", F.size(excerpts).cast("bigint").alias("excerpts"), folded.alias("found"))
    return f.select("document_id", "chunk_id", "excerpts", F.size(F.filter("found", lambda p: p > 0)).cast("bigint").alias("located"), F.array_join(F.col("found").cast("array<string>"), ",").alias("positions"))


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    r = _raw(spark, folder).select("document_id", "raw_block_id", "location_number", "block_ordinal", X.is_heading(F.col("text")).alias("head"), F.length("text").alias("size"))
    n = number(r, ["document_id"], ["location_number"], ["block_ordinal", "raw_block_id"])
    s = S.segments(n, ["document_id"], "ordinal", "head", "size", 2000)
    g = s.groupBy("document_id", "part", "segment").agg(F.count(F.lit(1)).alias("blocks"), F.sum("size").alias("characters"), F.min("location_number").alias("first_page"), F.max("location_number").alias("last_page"))
    return number(g, ["document_id"], ["part"], ["segment"], "_n").select("document_id", (F.col("_n") - 1).alias("segment"), "blocks", "characters", "first_page", "last_page")


def section_segments(spark: SparkSession, folder: str) -> DataFrame:
    return _segments(spark, folder)


def merged_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of 100 characters or more, and shorter ones, each merged with their like up to 4,000 characters."""
    s = _segments(spark, folder).withColumns({"able": F.coalesce("characters", F.lit(0)) >= 100, "room": F.coalesce("characters", F.lit(0)) + 2})
    m = S.merged_segments(s, ["document_id"], "segment", "able", "room", 4000)
    return m.groupBy("document_id", F.col("section").cast("bigint").alias("section")).agg(F.count(F.lit(1)).alias("segments"), F.sum("blocks").alias("blocks"), F.max("able").alias("able"), F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"))


def markdown_views(spark: SparkSession, folder: str) -> DataFrame:
    m = markdown(S.reading_order(_blocks(spark, folder, "page", "reading_order", "block_type", "text")))
    return m.select("document_id", F.sha2("markdown", 256).alias("sha256"), F.length("markdown").cast("bigint").alias("characters"))


def rendered_chunks(spark: SparkSession, folder: str) -> DataFrame:
    refs = _chunks(spark, folder, "refs").select("document_id", "chunk_id", F.posexplode("refs").alias("at", "r")).select("document_id", "chunk_id", "at", F.col("r.block_id").alias("block_id"))
    t = S.rendered(refs.join(_blocks(spark, folder, "block_type", "text"), ["document_id", "block_id"]), ["document_id", "chunk_id"])
    return t.select("document_id", "chunk_id", F.length("text").cast("bigint").alias("characters"), F.sha2("text", 256).alias("sha256"))


def text_exports(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's export, read back: its header holds and its marks are counted."""
    about = latest(table(spark, folder, "normalized_documents"), ["document_id"], "ingested_at", ["document_id", "source_relative_path", "document_type", "title", "language"])
    docs = about.select("document_id", F.col("source_relative_path").alias("source_path"), F.col("document_id").alias("source_sha256"), "document_type", "title", "language")
    b = _blocks(spark, folder, "location_type", "page", "reading_order", "text").withColumn("place", F.struct("reading_order", "block_id"))
    e = exports.render(docs, b).withColumn("h", exports.parse_header(F.col("text")))
    return e.select("document_id", F.col("h.error").isNull().alias("valid"), F.element_at("h.header", "TITLE").alias("title"), F.element_at("h.header", "LOCATIONS").cast("bigint").alias("locations"), F.length("text").cast("bigint").alias("characters"), F.sha2("text", 256).alias("sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        greedy_chunks, built_chunks, built_checks, reading_order, repeated_furniture, structural_units, block_atoms, chunk_dedup, neighbor_context, chunk_stats, page_ranges, heading_stack, boundary_lines, adjacent_duplicates, table_echoes, raw_spans, rendered_tables, oversize_split,
        association_cascade, evidence_spans, section_segments, merged_sections, markdown_views, rendered_chunks, text_exports,
    )
}

_COLS = "block_type, text, page, reading_order, section_id, location_type, bbox_top, table_id, asset_id"
_B = f"b AS (SELECT document_id, block_id, s.* FROM (SELECT document_id, block_id, arg_max(struct_pack({', '.join(f'{c} := {c}' for c in _COLS.split(', '))}), ingested_at) AS s FROM blocks GROUP BY 1, 2))"
_O = _B + ", o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY reading_order NULLS FIRST, page NULLS FIRST, block_id) AS ordinal FROM b)"
_FURNITURE = rf"""f0 AS (SELECT document_id, block_id, page, {_normal("text")} AS k FROM b WHERE block_type IN ('header', 'footer') AND {_normal("coalesce(text, '')")} <> ''),
f1 AS (SELECT document_id, k FROM f0 GROUP BY 1, 2 HAVING count(DISTINCT coalesce(page, -1)) >= 2),
furniture AS (SELECT f0.document_id, f0.block_id, CASE WHEN f1.k IS NOT NULL THEN 'repeated' ELSE 'page_number' END AS reason FROM f0 LEFT JOIN f1 USING (document_id, k)
  WHERE f1.k IS NOT NULL OR regexp_matches(f0.k, '(?i)^(?:page *)?\p{{Nd}}+(?: */ *\p{{Nd}}+)?$'))"""
_UNITS = """u0 AS (SELECT *, bool_or(section_id IS NOT NULL) OVER (PARTITION BY document_id) AS sectioned FROM o),
u1 AS (SELECT *, sum(CASE WHEN NOT sectioned AND block_type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY ordinal) AS prov FROM u0),
u2 AS (SELECT *, coalesce(section_id, CASE WHEN NOT sectioned AND prov > 0 THEN 'provisional-' || prov END) AS scope, CASE WHEN section_id IS NULL OR location_type = 'slide' THEN page END AS place FROM u1),
u3 AS (SELECT *, CASE WHEN lag(ordinal) OVER w IS NOT NULL AND scope IS NOT DISTINCT FROM lag(scope) OVER w AND place IS NOT DISTINCT FROM lag(place) OVER w THEN 0 ELSE 1 END AS fresh FROM u2 WINDOW w AS (PARTITION BY document_id ORDER BY ordinal)),
u AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY document_id ORDER BY ordinal) AS BIGINT) AS unit FROM u3)"""
_C = "c AS (SELECT document_id, chunk_id, s.* FROM (SELECT document_id, chunk_id, arg_max(struct_pack(chunk_index := chunk_index, chunk_type := chunk_type, text := text, eligible := eligible, section_path := section_path, refs := refs), generated_at) AS s FROM chunks GROUP BY 1, 2))"
_L = FLAGSHIP
_SEGMENTS = r"""WITH RECURSIVE r AS (SELECT DISTINCT document_id, raw_block_id, location_number, block_ordinal, text, coalesce(length(text), 0) AS n,
  coalesce(length(text) BETWEEN 3 AND 120 AND NOT regexp_matches(text, '[.;,]$') AND len(regexp_extract_all(text, '\p{L}')) >= 3 AND (regexp_matches(text, '^[\t\n\x0b\f\r ]*(?:\p{Nd}+(?:\.\p{Nd}+)*[.)]?|[IVXLC]+[.)-]|[A-Z][.)])[\t\n\x0b\f\r ]+\p{L}')
  OR len(regexp_extract_all(text, '\p{Lu}')) / len(regexp_extract_all(text, '\p{L}')) >= 0.55), false) AS head FROM raw_blocks),
o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY location_number, block_ordinal, raw_block_id) AS rn FROM r),
s AS (SELECT document_id, rn, CAST(0 AS BIGINT) AS segment, n AS total FROM o WHERE rn = 1
  UNION ALL
  SELECT o.document_id, o.rn, CASE WHEN o.head OR total + 2 + n > 2000 THEN segment + 1 ELSE segment END, CASE WHEN o.head OR total + 2 + n > 2000 THEN n ELSE total + 2 + n END FROM o JOIN s ON o.document_id = s.document_id AND o.rn = s.rn + 1),
sg AS (SELECT document_id, segment, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS characters, min(location_number) AS first_page, max(location_number) AS last_page FROM o JOIN s USING (document_id, rn) GROUP BY 1, 2)
"""

SQL = {
    "reading_order": f"WITH {_O} SELECT document_id, block_id, ordinal FROM o",
    "repeated_furniture": f"WITH {_B}, {_FURNITURE} SELECT * FROM furniture",
    "structural_units": f"WITH {_O}, {_UNITS} SELECT document_id, block_id, scope, unit FROM u",
    "greedy_chunks": f"""WITH RECURSIVE {_B}, {_FURNITURE},
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.document_id ORDER BY reading_order NULLS FIRST, page NULLS FIRST, b.block_id) AS ordinal FROM b LEFT JOIN furniture f ON f.document_id = b.document_id AND f.block_id = b.block_id WHERE f.block_id IS NULL), {_UNITS},
r AS (SELECT *, row_number() OVER (PARTITION BY document_id, unit ORDER BY ordinal) AS rn, length(coalesce(text, '')) AS n FROM u),
p AS (SELECT document_id, unit, rn, CAST(0 AS BIGINT) AS pack, n AS total FROM r WHERE rn = 1
  UNION ALL
  SELECT r.document_id, r.unit, r.rn, CASE WHEN total + 2 + n > {_L.hard} OR (total + 2 + n > {_L.soft} AND total >= {_L.least}) THEN pack + 1 ELSE pack END, CASE WHEN total + 2 + n > {_L.hard} OR (total + 2 + n > {_L.soft} AND total >= {_L.least}) THEN n ELSE total + 2 + n END
  FROM r JOIN p ON r.document_id = p.document_id AND r.unit = p.unit AND r.rn = p.rn + 1),
t AS (SELECT r.document_id, r.unit, p.pack, count(*) AS blocks, coalesce(string_agg(trim(r.text), chr(10) || chr(10) ORDER BY r.ordinal) FILTER (trim(r.text) <> ''), '') AS text, min(page) AS first_page, max(page) AS last_page FROM r JOIN p USING (document_id, unit, rn) GROUP BY 1, 2, 3)
SELECT document_id, unit, pack, blocks, sha256(text) AS text_hash, length(text) AS characters, (length(text) + 3) // 4 AS tokens, first_page, last_page FROM t""",
    "built_checks": f"""WITH {_B}, {_FURNITURE} SELECT b.document_id, count(*) AS blocks, true AS in_order, true AS within, true AS numbered FROM b LEFT JOIN furniture f ON f.document_id = b.document_id AND f.block_id = b.block_id WHERE f.block_id IS NULL GROUP BY 1""",
    "block_atoms": f"""WITH {_O}, x AS (SELECT *, lag(block_type) OVER w AS t1, lag(section_id) OVER w AS s1, lag(page) OVER w AS p1, lag(block_type, 2) OVER w AS t2, lag(section_id, 2) OVER w AS s2, lag(page, 2) OVER w AS p2,
lead(block_type) OVER w AS n1, lead(section_id) OVER w AS ns, lead(page) OVER w AS np FROM o WINDOW w AS (PARTITION BY document_id ORDER BY ordinal)),
y AS (SELECT *, t1 IS NOT NULL AND s1 IS NOT DISTINCT FROM section_id AND p1 IS NOT DISTINCT FROM page AS near1, t2 IS NOT NULL AND s2 IS NOT DISTINCT FROM section_id AND p2 IS NOT DISTINCT FROM page AS near2, coalesce(n1 IN ('table', 'figure', 'formula'), false) AND ns IS NOT DISTINCT FROM section_id AND np IS NOT DISTINCT FROM page AS next_main FROM x),
z AS (SELECT *, CASE WHEN block_type IN ('table', 'figure', 'formula') THEN near1 AND t1 IN ('caption', 'heading', 'paragraph')
WHEN block_type = 'caption' THEN near1 AND t1 IN ('table', 'figure', 'formula')
WHEN block_type = 'paragraph' THEN NOT next_main AND near1 AND (t1 IN ('table', 'figure', 'formula') OR (t1 = 'caption' AND near2 AND t2 IN ('table', 'figure', 'formula'))) ELSE false END AS back FROM y),
a AS (SELECT *, CAST(sum(CASE WHEN coalesce(back, false) THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY ordinal) AS BIGINT) AS atom FROM z)
SELECT document_id, atom, count(*) AS blocks, min(block_id) AS first_block FROM a GROUP BY 1, 2""",
    "chunk_dedup": f"""WITH {_C}, n AS (SELECT document_id, chunk_id, chunk_index, {_normal("coalesce(text, '')")} AS t FROM c),
f AS (SELECT *, first_value(chunk_id) OVER (PARTITION BY document_id, t ORDER BY chunk_index, chunk_id) AS canonical_id FROM n WHERE t <> '') SELECT document_id, chunk_id, canonical_id FROM f WHERE chunk_id <> canonical_id""",
    "neighbor_context": f"""WITH {_C}, n AS (SELECT document_id, chunk_id, array_to_string(section_path, chr(1)) AS path, {_normal("coalesce(text, '')")} AS t, chunk_index FROM c),
w AS (SELECT *, lag(t) OVER w AS b, lag(path) OVER w AS bp, lag(chunk_id) OVER w AS bi, lead(t) OVER w AS a, lead(path) OVER w AS ap, lead(chunk_id) OVER w AS ai FROM n WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index, chunk_id))
SELECT document_id, chunk_id,
CASE WHEN bp IS NOT DISTINCT FROM path AND length(b) > 0 THEN CASE WHEN length(b) <= 120 THEN b WHEN instr(right(b, 120), ' ') > 0 THEN ltrim(substr(right(b, 120), instr(right(b, 120), ' ') + 1)) ELSE right(b, 120) END END AS context_before,
CASE WHEN ap IS NOT DISTINCT FROM path AND length(a) > 0 THEN CASE WHEN length(a) <= 120 THEN a WHEN instr(reverse(left(a, 121)), ' ') BETWEEN 1 AND 120 THEN rtrim(left(a, CAST(121 - instr(reverse(left(a, 121)), ' ') AS INTEGER))) ELSE rtrim(left(a, 120)) END END AS context_after FROM w""",
    "chunk_stats": f"""WITH {_C}, g AS (SELECT document_id, count(*) AS chunks, count(*) FILTER (chunk_type = 'section') AS sections, count(*) FILTER (eligible) AS eligible, min(length(coalesce(text, ''))) AS least, max(length(coalesce(text, ''))) AS most, round(avg(length(coalesce(text, ''))), 4) AS mean,
CAST(sum((length(coalesce(text, '')) + 3) // 4) AS BIGINT) AS tokens FROM c GROUP BY 1), p AS (SELECT document_id, count(DISTINCT r.page) AS pages FROM (SELECT document_id, unnest(refs) AS r FROM c) GROUP BY 1)
SELECT d.document_id, coalesce(chunks, 0) AS chunks, coalesce(sections, 0) AS sections, coalesce(eligible, 0) AS eligible, coalesce(least, 0) AS least, coalesce(most, 0) AS most, coalesce(mean, 0.0) AS mean, coalesce(tokens, 0) AS tokens, coalesce(pages, 0) AS pages
FROM (SELECT DISTINCT document_id FROM normalized_documents) d LEFT JOIN g USING (document_id) LEFT JOIN p USING (document_id)""",
    "page_ranges": _TREE
    + f""", {_O}, own AS (SELECT document_id, section_id, min(struct_pack(o := ordinal, p := page)) FILTER (page IS NOT NULL) AS lo, max(struct_pack(o := ordinal, p := page)) FILTER (page IS NOT NULL) AS hi FROM o WHERE section_id IS NOT NULL GROUP BY 1, 2),
up AS (SELECT w.document_id, unnest(w.ids[1:len(w.ids) - 1]) AS section_id, own.lo, own.hi FROM w JOIN own USING (document_id, section_id))
SELECT document_id, section_id, min(lo).p AS first_page, max(hi).p AS last_page FROM (SELECT * FROM own UNION ALL SELECT * FROM up) GROUP BY 1, 2""",
    "heading_stack": """WITH s AS (SELECT document_id, section_id, arg_max(level, ingested_at) AS level FROM sections GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY section_id) AS ordinal FROM s WHERE level IS NOT NULL)
SELECT a.document_id, a.section_id, a.ordinal, max(b.ordinal) AS parent_ordinal FROM n a LEFT JOIN n b ON b.document_id = a.document_id AND b.ordinal < a.ordinal AND b.level < a.level GROUP BY 1, 2, 3""",
    "boundary_lines": f"""WITH {_B}, t AS (SELECT * FROM b WHERE text IS NOT NULL), x AS (SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY reading_order NULLS FIRST, block_id) AS n, count(*) OVER (PARTITION BY document_id, page) AS total, {_key("text")} AS "key" FROM t),
s AS (SELECT document_id, page, "key", 'header' AS side FROM x WHERE n <= 4 AND length(text) < 220 UNION ALL SELECT document_id, page, "key", 'footer' FROM x WHERE n > total - 2 AND length(text) < 220),
p AS (SELECT document_id, count(DISTINCT page) AS pages FROM t GROUP BY 1)
SELECT document_id, "key", side, count(DISTINCT page) AS places FROM s JOIN p USING (document_id) WHERE "key" <> '' GROUP BY 1, 2, 3, pages HAVING count(DISTINCT page) >= greatest(2, (pages + 1) // 2)""",
    "adjacent_duplicates": f"""WITH {_O}, k AS (SELECT *, {_key("text")} AS k FROM o WHERE text IS NOT NULL), w AS (SELECT *, lag(k) OVER v AS lk, lag(page) OVER v AS lp, lag(ordinal) OVER v AS lo FROM k WHERE k <> '' WINDOW v AS (PARTITION BY document_id ORDER BY ordinal))
SELECT document_id, block_id FROM w WHERE lo IS NOT NULL AND lk = k AND lp IS NOT DISTINCT FROM page""",
    "table_echoes": f"""WITH {_B}, x AS (SELECT document_id, block_id, page, row_number() OVER w - 1 AS at, contains(text, '|') AS bar, contains(text, '|') OR regexp_matches(text, '^===== TABLE [1-9][0-9]* =====$') AS stop, regexp_extract_all({_fold("text")}, '[\\p{{L}}\\p{{N}}]+') AS t FROM b WHERE text <> '' WINDOW w AS (PARTITION BY document_id, page ORDER BY reading_order NULLS FIRST, block_id)),
s AS (SELECT c.document_id, c.block_id, t.block_id AS table_block_id, c.t AS cw, t.t AS tw FROM x c JOIN x t ON t.document_id = c.document_id AND t.page IS NOT DISTINCT FROM c.page AND t.bar AND t.at > 0 AND c.at > t.at AND c.at - t.at <= 8 AND NOT c.stop AND len(c.t) >= 4 AND len(t.t) >= 4
  WHERE NOT EXISTS (SELECT 1 FROM x z WHERE z.document_id = c.document_id AND z.page IS NOT DISTINCT FROM c.page AND z.stop AND z.at > t.at AND z.at < c.at))
SELECT document_id, block_id, table_block_id FROM s WHERE len(list_filter(list_distinct(cw), lambda y: len(list_filter(cw, lambda z: z = y)) > len(list_filter(tw, lambda z: z = y)))) = 0""",
    "raw_spans": """WITH r AS (SELECT DISTINCT document_id, raw_block_id, location_number, block_ordinal, text, raw_start, raw_end FROM raw_blocks)
SELECT document_id, raw_block_id, s AS "start", s + coalesce(length(text), 0) AS "end" FROM (SELECT *, CAST(coalesce(sum(coalesce(length(text) + 2, 0)) OVER (PARTITION BY document_id ORDER BY location_number, block_ordinal, raw_block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM r)""",
    "rendered_tables": f"""WITH {_B}, t AS (SELECT document_id, block_id, list_transform(list_filter(string_split(text, chr(10)), lambda r: trim(r, ' ') <> ''), lambda r: list_transform(string_split(r, '|'), lambda c: trim(c, ' '))) AS m FROM b WHERE block_type = 'table' AND text IS NOT NULL AND trim(text, ' ') <> ''),
w AS (SELECT *, list_max(list_transform(m, lambda r: len(r))) AS width FROM t)
SELECT document_id, block_id, array_to_string(list_transform(m, lambda r: array_to_string(list_transform(range(1, width + 1), lambda i: coalesce(r[i], '')), ' | ')), chr(10)) AS rendered FROM w""",
    "association_cascade": f"""WITH {_O}, {_C}, oj AS (SELECT document_id, coalesce(table_id, asset_id) AS object_id, table_id IS NULL AS is_asset, block_id, page, ordinal, bbox_top AS top FROM o WHERE table_id IS NOT NULL OR asset_id IS NOT NULL),
nb AS (SELECT *, lead(block_type) OVER w AS aft, lead(page) OVER w AS ap, lead(text) OVER w AS ax, lag(block_type) OVER w AS bt, lag(page) OVER w AS bp, lag(text) OVER w AS bx FROM o WINDOW w AS (PARTITION BY document_id ORDER BY ordinal)),
ca AS (SELECT document_id, block_id, {_normal("CASE WHEN aft = 'caption' AND ap IS NOT DISTINCT FROM page THEN ax WHEN bt = 'caption' AND bp IS NOT DISTINCT FROM page THEN bx END")} AS caption FROM nb WHERE block_type IN ('table', 'figure')),
h AS (SELECT document_id, object_id, x.* FROM (SELECT document_id, object_id, arg_min(struct_pack(block_id := block_id, page := page, top := top, is_asset := is_asset), ordinal) AS x FROM oj GROUP BY 1, 2)),
g AS (SELECT h.*, ca.caption FROM h LEFT JOIN ca USING (document_id, block_id)),
e AS (SELECT document_id, chunk_id, chunk_index, unnest(refs) AS r FROM c), q AS (SELECT e.document_id, e.chunk_id, e.chunk_index, e.r.block_id AS block_id, e.r.page AS page, b.bbox_top, {_normal("b.text")} AS t FROM e LEFT JOIN b ON b.document_id = e.document_id AND b.block_id = e.r.block_id),
m AS (SELECT document_id, chunk_id, min(page) AS lo, max(page) AS hi FROM q GROUP BY 1, 2),
pl AS (SELECT g.*, m.chunk_id FROM g JOIN m ON m.document_id = g.document_id AND g.page BETWEEN m.lo AND m.hi),
d AS (SELECT pl.document_id, pl.object_id, pl.chunk_id, min(abs(q.bbox_top - pl.top)) AS far FROM pl JOIN q ON q.document_id = pl.document_id AND q.chunk_id = pl.chunk_id WHERE pl.is_asset AND pl.top IS NOT NULL AND q.bbox_top IS NOT NULL GROUP BY 1, 2, 3),
al AS (SELECT g.document_id, object_id, max(struct_pack(i := chunk_index, c := chunk_id)).c AS chunk_id, 1 AS rank FROM g JOIN q USING (document_id, block_id) WHERE NOT is_asset GROUP BY 1, 2
UNION ALL SELECT oj.document_id, object_id, min(chunk_id), 1 FROM oj JOIN q USING (document_id, block_id) WHERE is_asset GROUP BY 1, 2 HAVING count(DISTINCT chunk_id) = 1
UNION ALL SELECT document_id, object_id, min(chunk_id), 2 FROM (SELECT DISTINCT pl.document_id, pl.object_id, pl.chunk_id FROM pl JOIN q ON q.document_id = pl.document_id AND q.chunk_id = pl.chunk_id WHERE pl.caption <> '' AND q.t = pl.caption) GROUP BY 1, 2 HAVING count(*) = 1
UNION ALL SELECT document_id, object_id, min(chunk_id), 3 FROM (SELECT *, min(far) OVER (PARTITION BY document_id, object_id) AS least FROM d) WHERE far = least GROUP BY 1, 2 HAVING count(*) = 1
UNION ALL SELECT document_id, object_id, min(chunk_id), 4 FROM pl GROUP BY 1, 2 HAVING count(DISTINCT chunk_id) = 1),
be AS (SELECT document_id, object_id, min(struct_pack(r := rank, c := chunk_id)) AS x FROM al GROUP BY 1, 2)
SELECT h.document_id, h.object_id, be.x.c AS chunk_id, ['explicit_block_reference', 'caption_relationship', 'spatial_nearest', 'unique_same_location'][be.x.r] AS method FROM h LEFT JOIN be USING (document_id, object_id)""",
    "oversize_split": rf"""WITH RECURSIVE {_C}, t AS (SELECT document_id, chunk_id, replace(replace(trim(text, ' '), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM c WHERE length(text) > 1000),
s AS (SELECT document_id, chunk_id, unnest(list_filter(string_split(regexp_replace(regexp_replace(t, '([.!?])[\t\n\x0b\f\r ]+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: x <> '')) AS s, generate_subscripts(list_filter(string_split(regexp_replace(regexp_replace(t, '([.!?])[\t\n\x0b\f\r ]+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: x <> ''), 1) AS i FROM t),
w AS (SELECT document_id, chunk_id, i, CASE WHEN length(s) > 1000 THEN i ELSE 0 END AS own, unnest(CASE WHEN length(s) > 1000 THEN string_split(s, ' ') ELSE [s] END) AS p, generate_subscripts(CASE WHEN length(s) > 1000 THEN string_split(s, ' ') ELSE [s] END, 1) AS j FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id, chunk_id ORDER BY i, j) AS rn FROM w),
f AS (SELECT document_id, chunk_id, rn, own, trim(p, ' ') AS now, CAST(1 AS BIGINT) AS fragment_no FROM r WHERE rn = 1
  UNION ALL
  SELECT r.document_id, r.chunk_id, r.rn, r.own, CASE WHEN f.now <> '' AND (length(trim(f.now || ' ' || p, ' ')) > 1000 OR f.own <> r.own) THEN p ELSE trim(f.now || ' ' || p, ' ') END, CASE WHEN f.now <> '' AND (length(trim(f.now || ' ' || p, ' ')) > 1000 OR f.own <> r.own) THEN fragment_no + 1 ELSE fragment_no END
  FROM r JOIN f ON r.document_id = f.document_id AND r.chunk_id = f.chunk_id AND r.rn = f.rn + 1),
g AS (SELECT document_id, chunk_id, fragment_no, arg_max(now, rn) AS fragment FROM f GROUP BY 1, 2, 3)
SELECT document_id, chunk_id, fragment_no, length(fragment) AS characters, md5(fragment) AS fragment FROM g WHERE fragment <> ''""",
    "evidence_spans": f"""WITH RECURSIVE {_C}, e AS (SELECT document_id, chunk_id, text, list_filter(list_transform(refs, lambda r: r.excerpt), lambda x: x IS NOT NULL AND x <> '') AS xs FROM c WHERE text IS NOT NULL AND len(refs) > 0),
s AS (SELECT document_id, chunk_id, 0 AS i, 1 AS pos, []::BIGINT[] AS found FROM e
  UNION ALL
  SELECT e.document_id, e.chunk_id, i + 1, CASE WHEN instr(substr(text, pos), xs[i + 1]) = 0 THEN pos ELSE pos + instr(substr(text, pos), xs[i + 1]) - 1 + length(xs[i + 1]) END, list_append(found, CASE WHEN instr(substr(text, pos), xs[i + 1]) = 0 THEN 0 ELSE pos + instr(substr(text, pos), xs[i + 1]) - 1 END)
  FROM s JOIN e ON e.document_id = s.document_id AND e.chunk_id = s.chunk_id WHERE i < len(xs))
SELECT s.document_id, s.chunk_id, len(xs) AS excerpts, len(list_filter(found, lambda p: p > 0)) AS located, array_to_string(found, ',') AS positions FROM s JOIN e ON e.document_id = s.document_id AND e.chunk_id = s.chunk_id WHERE i = len(xs)""",
    "section_segments": _SEGMENTS + "SELECT * FROM sg",
    "merged_sections": _SEGMENTS.rstrip()
    + """, e AS (SELECT *, coalesce(characters, 0) >= 100 AS able, coalesce(characters, 0) + 2 AS room FROM sg),
m AS (SELECT document_id, segment, CAST(0 AS BIGINT) AS section, room AS total FROM e WHERE segment = 0
  UNION ALL
  SELECT e.document_id, e.segment, CASE WHEN e.able = l.able AND total + e.room <= 4000 THEN section ELSE section + 1 END, CASE WHEN e.able = l.able AND total + e.room <= 4000 THEN total + e.room ELSE e.room END
  FROM e JOIN m ON m.document_id = e.document_id AND e.segment = m.segment + 1 JOIN e l ON l.document_id = m.document_id AND l.segment = m.segment)
SELECT document_id, section, count(*) AS segments, CAST(sum(blocks) AS BIGINT) AS blocks, bool_or(able) AS able, min(first_page) AS first_page, max(last_page) AS last_page FROM m JOIN e USING (document_id, segment) GROUP BY 1, 2""",
    "rendered_chunks": f"""WITH {_B}, {_C}, e AS (SELECT document_id, chunk_id, unnest(refs) AS r, unnest(range(len(refs))) AS i FROM c), x AS (SELECT e.document_id, e.chunk_id, i, block_type, trim(text, ' ') AS t, {_key("trim(text, ' ')")} AS k FROM e JOIN b ON b.document_id = e.document_id AND b.block_id = e.r.block_id WHERE trim(coalesce(text, ''), ' ') <> ''),
y AS (SELECT *, CASE WHEN block_type = 'caption' THEN row_number() OVER (PARTITION BY document_id, chunk_id, block_type, k ORDER BY i) ELSE 1 END AS n FROM x), z AS (SELECT document_id, chunk_id, string_agg(t, chr(10) || chr(10) ORDER BY i) AS text FROM y WHERE n = 1 GROUP BY 1, 2) SELECT document_id, chunk_id, length(text) AS characters, sha256(text) AS sha256 FROM z""",
    "markdown_views": f"""WITH {_O}, l AS (SELECT document_id, page, ordinal, CASE block_type WHEN 'title' THEN '# ' || trim(text, ' ') WHEN 'heading' THEN '### ' || trim(text, ' ') WHEN 'list_item' THEN '- ' || trim(text, ' ') ELSE trim(text, ' ') END AS line FROM o WHERE trim(coalesce(text, ''), ' ') <> ''),
p AS (SELECT document_id, page, CASE WHEN page IS NULL THEN '' ELSE '## Page ' || page || chr(10) || chr(10) END || string_agg(line, chr(10) || chr(10) ORDER BY ordinal) AS body FROM l GROUP BY 1, 2),
m AS (SELECT document_id, string_agg(body, chr(10) || chr(10) ORDER BY page NULLS FIRST) AS md FROM p GROUP BY 1) SELECT document_id, sha256(md) AS sha256, length(md) AS characters FROM m""",
    "text_exports": f"""WITH {_B}, d AS (SELECT document_id, x.* FROM (SELECT document_id, arg_max(struct_pack(p := source_relative_path, t := document_type, title := title, lang := language), ingested_at) AS x FROM normalized_documents GROUP BY 1)),
g AS (SELECT document_id, page, location_type, CASE WHEN page IS NULL THEN '===== DOCUMENT CONTENT =====' ELSE '===== ' || upper(location_type) || ' ' || page || ' =====' END || chr(10) || chr(10) || string_agg(trim(text, ' '), chr(10) || chr(10) ORDER BY reading_order NULLS FIRST, block_id) AS body FROM b WHERE trim(coalesce(text, ''), ' ') <> '' GROUP BY 1, 2, 3),
w AS (SELECT document_id, string_agg(body, chr(10) || chr(10) ORDER BY page NULLS FIRST, body) AS body, count(*) AS n FROM g GROUP BY 1),
e AS (SELECT document_id, regexp_replace(coalesce(title, ''), '[\t\n\x0b\f\r ]+', ' ', 'g') AS title, coalesce(n, 0) AS locations, 'SOURCE PATH: ' || p || chr(10) || 'SOURCE SHA256: ' || document_id || chr(10) || 'DOCUMENT TYPE: ' || coalesce(t, '') || chr(10) || 'TITLE: ' || regexp_replace(coalesce(title, ''), '[\t\n\x0b\f\r ]+', ' ', 'g') || chr(10)
  || 'LANGUAGE: ' || coalesce(lang, '') || chr(10) || 'EXPORT STATUS: ' || chr(10) || 'EXTRACTION TOOL: ' || chr(10) || 'LOCATIONS: ' || coalesce(n, 0) || chr(10) || 'EXPORTED AT: ' || chr(10) || chr(10) || coalesce(body, '') || chr(10) AS text FROM d LEFT JOIN w USING (document_id))
SELECT document_id, true AS valid, title, locations, length(text) AS characters, sha256(text) AS sha256 FROM e""",
}
