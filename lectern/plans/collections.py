"""Queries on collections of chunks, on the common model and on how far each source has come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import collection as C
from lectern.operators import normalizing as N
from lectern.operators import progress as P
from lectern.operators.auditing import accepted
from lectern.operators.structure import duplicate_chunks, reading_order
from lectern.plans.audits import SQL as _AUDITS
from lectern.plans.audits import audit_issues
from lectern.plans.qualities import SQL as _QUALITIES
from lectern.plans.qualities import document_readiness
from lectern.plans.structures import _B, _O, _blocks, _chunks
from lectern.plans.texts import SQL as _TEXTS
from lectern.plans.texts import _key, _normal, _strip, cleaning_decisions
from lectern.session import cut_lineage
from lectern.sources.tables import latest, table

_STATES = {"accepted": P.DONE, "rejected": P.FAILURE, "needs_human_review": P.NEEDS_REVIEW}


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "normalized_documents"), ["document_id"], "ingested_at", ["document_id", "source_relative_path", "source_extension", "document_type", "classification", "parser_name"])


def _collection(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder, "chunk_index", "chunk_type", "text", "refs", "eligible").withColumn("n_references", F.coalesce(F.size("refs"), F.lit(0)))


def chunk_collection(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks without duplicates, renumbered, with what makes them unfit."""
    c = _collection(spark, folder)
    kinds = c.select("document_id", "chunk_id", F.explode("refs.block_id").alias("block_id")).join(_blocks(spark, folder, "block_type"), ["document_id", "block_id"])
    e = C.eligibility(c, kinds)
    kept = C.retained(c.select("document_id", "chunk_id", "chunk_index"), duplicate_chunks(c))
    return kept.join(e, ["document_id", "chunk_id"]).select("document_id", "chunk_id", "position", F.col("eligible"), "reasons")


def collection_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return C.statistics(_collection(spark, folder), _documents(spark, folder))


def dataset_issues(spark: SparkSession, folder: str) -> DataFrame:
    c = _chunks(spark, folder, "source_relative_path", "refs")
    objects = _blocks(spark, folder, "table_id", "asset_id").select("document_id", "block_id", F.coalesce("table_id", "asset_id").alias("object_id"), F.col("table_id").isNotNull().alias("is_table")).filter("object_id is not null")
    held = c.select("document_id", "chunk_id", F.explode("refs.block_id").alias("block_id")).join(objects, ["document_id", "block_id"]).select("document_id", "chunk_id", "object_id")
    return C.dataset_issues(c.select("document_id", "chunk_id", "source_relative_path"), _documents(spark, folder), held, objects.filter("is_table").select("document_id", "object_id").distinct())


def stage_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """The furthest stage each document has reached: blocks with text, chunks, chunks that can be used, a cleaned derivative of the same path."""
    d = _documents(spark, folder)
    solid = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    c = _chunks(spark, folder, "text", "eligible").filter(solid("text"))
    sidecars = table(spark, folder, "cleaning_sidecars").select(F.col("source_sha256").alias("document_id"), F.col("source_relative_path").alias("path"))
    stages = {
        "canonical": table(spark, folder, "blocks").filter(solid("text")), "chunks": c, "dataset": c.filter("eligible"), "derivative": d.join(sidecars, "document_id").filter("path = source_relative_path"),
    }
    return P.furthest(d, stages, "document_id")


def export_discovery(spark: SparkSession, folder: str) -> DataFrame:
    """Sidecars as exports, held against the documents as their manifest."""
    exports = table(spark, folder, "cleaning_sidecars").select(F.col("source_relative_path").alias("path"), F.col("source_sha256").alias("sha256"))
    d = _documents(spark, folder)
    status = F.when(F.col("classification") == "likely_scanned", "requires_ocr").otherwise("exported")
    manifest = d.groupBy(F.col("source_relative_path").alias("path")).agg(F.max(F.struct(F.col("document_id").alias("sha256"), status.alias("status"))).alias("x")).select("path", "x.*")
    return P.discovered(exports, manifest)


def eligible_exports(spark: SparkSession, folder: str) -> DataFrame:
    """The first fifty files whose export was asked for (a report of fixed length)."""
    one = _documents(spark, folder).groupBy("source_relative_path").agg(F.max("document_id").alias("document_id"))
    return P.eligible(one, "source_relative_path", ["pdf", "docx", "pptx", "txt"], ["pdf", "pptx", "epub"], 50)


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    size = F.length(F.trim(F.coalesce("text", F.lit("")))).alias("size")
    pages = _blocks(spark, folder, "page", size).groupBy("document_id", "page").agg(F.sum("size").alias("size"))
    g = pages.groupBy("document_id").agg(F.sum("size").alias("characters"), F.count_if(F.col("size") == 0).alias("warnings"))
    d = _documents(spark, folder).join(g, "document_id", "left")
    supported = F.coalesce(F.col("source_extension").isin(".pdf", ".docx", ".pptx"), F.lit(False))
    outcome = P.export_outcome(F.col("characters"), F.col("warnings"), F.coalesce(F.col("classification") == "likely_scanned", F.lit(False)), supported)
    tool = F.concat_ws("+", "parser_name", F.when(F.col("classification").isin("likely_scanned", "mixed"), "ocr"))
    return d.select("document_id", "source_relative_path", "document_type", outcome.alias("outcome"), tool.alias("tool"), F.coalesce("characters", F.lit(0)).alias("characters"))


def export_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return _outcomes(spark, folder).select("document_id", "outcome", "tool", "characters")


def export_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Exports by outcome; characters of exported ones only."""
    done = F.col("outcome").isin("exported", "exported_with_warnings")
    return _outcomes(spark, folder).groupBy("outcome").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.when(done, F.col("characters")).otherwise(0)).alias("characters"))


def character_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Characters of every document's blocks: as they are in PDF files, without the white space around them in others."""
    t = F.coalesce("text", F.lit(""))
    sizes = _blocks(spark, folder, F.length(t).alias("whole"), F.length(X.strip(t)).alias("bare"))
    d = _documents(spark, folder).select("document_id", "document_type")
    size = F.when(F.col("document_type") == "pdf", F.col("whole")).otherwise(F.col("bare"))
    return sizes.join(d, "document_id").groupBy("document_id").agg(F.sum(size).alias("characters"), F.count_if(F.col("bare") > 0).alias("texts"))


def second_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return P.second_decisions(table(spark, folder, "events"), "user_id", "ts", "event_id", "event_type", ["purchase", "error"])


def export_entries(spark: SparkSession, folder: str) -> DataFrame:
    return _outcomes(spark, folder).select("document_id", P.export_entry(F.col("source_relative_path"), F.col("document_id"), F.col("outcome"), F.col("tool")).alias("entry_id"), "document_type")


def reconstruction_states(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["document_id", "transformation_id"]
    known = F.create_map(*[F.lit(v) for x in _STATES.items() for v in x])
    t = latest(table(spark, folder, "model_transformations").select(*keys, "validation_status", "ingested_at"), keys, "ingested_at")
    parts = t.select("document_id", F.coalesce(F.try_element_at(known, "validation_status"), F.lit(P.UNCHANGED)).alias("status"))
    return P.reconstruction_status(parts, table(spark, folder, "cleaning_sidecars").select(F.col("source_sha256").alias("document_id"), F.col("readiness_status").alias("readiness")))


def preparation_report(spark: SparkSession, folder: str) -> DataFrame:
    """What a preparation did: readiness and states of documents, decisions on blocks, additions and changes found in rewritings."""
    a = audit_issues(spark, folder).filter(F.col("code").startswith("unsupported_") | F.col("code").startswith("changed_"))
    return P.run_report({"readiness": (document_readiness(spark, folder), "status"), "reconstruction": (reconstruction_states(spark, folder), "status"), "suppressed": (cleaning_decisions(spark, folder).filter("not retained"), "reason"), "suspicious": (a, "code")})


def raw_candidates(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "raw_blocks").select("document_id", F.col("location_number").alias("page"), F.col("block_ordinal").alias("place"), F.col("raw_block_id").alias("block_id"), "text").distinct()
    c = N.text_candidates(r)
    return c.select("document_id", "page", F.col("ordinal"), "block_id", F.length("text").cast("bigint").alias("characters"), F.md5("key").alias("key"))


def padded_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The id each block has by its place in reading order."""
    return reading_order(_blocks(spark, folder, "page", "reading_order")).select("document_id", "block_id", N.padded("block", F.col("ordinal")).alias("padded"))


def source_references(spark: SparkSession, folder: str) -> DataFrame:
    d = _documents(spark, folder).select("document_id", "source_relative_path", N.location_type(F.col("document_type")).alias("kind"))
    b = _blocks(spark, folder, "page", "source_excerpt").join(d, "document_id")
    return b.select("document_id", N.reference(F.col("source_relative_path"), F.col("kind"), F.col("page"), F.col("block_id"), F.col("source_excerpt")).alias("r")).select("document_id", "r.*")


def accepted_union(spark: SparkSession, folder: str) -> DataFrame:
    """The accepted transformations of every type, as one bag."""
    keys = ["document_id", "transformation_id"]
    t = cut_lineage(latest(table(spark, folder, "model_transformations").select(*keys, "transformation_type", "validation_status", "ingested_at"), keys, "ingested_at"))
    kinds = ["paragraph_reassembly", "split_word_repair"]
    batches = [t.filter(F.col("transformation_type") == k) for k in kinds] + [t.filter(~F.coalesce(F.col("transformation_type").isin(kinds), F.lit(False)))]
    return accepted(*batches, status="validation_status").select(*keys, "transformation_type")


def chunk_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """One chunk by its id (here the smallest): a filter that reaches the scan."""
    c = table(spark, folder, "chunks")
    wanted = c.agg(F.min("chunk_id")).first()[0]
    return latest(c.filter(F.col("chunk_id") == F.lit(wanted)).select("chunk_id", "document_id", "chunk_index", F.length("text").cast("bigint").alias("characters"), "generated_at"), ["chunk_id"], "generated_at").select("chunk_id", "document_id", "chunk_index", "characters")


QUERIES = {
    f.__name__: f
    for f in (
        chunk_collection, collection_statistics, dataset_issues, stage_cascade, export_discovery, eligible_exports, export_outcomes, export_summary, character_counts, second_decisions, export_entries, reconstruction_states, preparation_report, raw_candidates, padded_ids, source_references, accepted_union, chunk_lookup,
    )
}

_D = "d AS (SELECT document_id, x.* FROM (SELECT document_id, arg_max(struct_pack(path := source_relative_path, ext := source_extension, kind := document_type, cls := classification, parser := parser_name), ingested_at) AS x FROM normalized_documents GROUP BY 1))"
_K = "k AS (SELECT document_id, chunk_id, x.*, coalesce(len(x.refs), 0) AS n_refs FROM (SELECT document_id, chunk_id, arg_max(struct_pack(chunk_index := chunk_index, chunk_type := chunk_type, text := text, refs := refs, el := eligible, path := source_relative_path), generated_at) AS x FROM chunks GROUP BY 1, 2))"
_DUP = f"dup AS (SELECT document_id, chunk_id FROM (SELECT document_id, chunk_id, first_value(chunk_id) OVER (PARTITION BY document_id, t ORDER BY chunk_index, chunk_id) AS head FROM (SELECT *, {_normal("coalesce(text, '')")} AS t FROM k) WHERE t <> '') WHERE chunk_id <> head)"
_TYPES = "CASE kind WHEN 'pdf' THEN 'page' WHEN 'powerpoint' THEN 'slide' WHEN 'word' THEN 'document' END"
_OUT = f"""{_B}, {_D}, pg AS (SELECT document_id, page, sum(length(trim(coalesce(text, ''), ' '))) AS n FROM b GROUP BY 1, 2), g AS (SELECT document_id, CAST(sum(n) AS BIGINT) AS characters, count(*) FILTER (n = 0) AS warnings FROM pg GROUP BY 1),
o AS (SELECT d.document_id, path, kind, coalesce(characters, 0) AS characters, CASE WHEN NOT coalesce(ext IN ('.pdf', '.docx', '.pptx'), false) THEN 'unsupported' WHEN coalesce(characters, 0) = 0 AND cls = 'likely_scanned' THEN 'requires_ocr' WHEN coalesce(characters, 0) = 0 THEN 'empty' WHEN warnings > 0 THEN 'exported_with_warnings' ELSE 'exported' END AS outcome,
  concat_ws('+', parser, CASE WHEN cls IN ('likely_scanned', 'mixed') THEN 'ocr' END) AS tool FROM d LEFT JOIN g USING (document_id))"""
_RECON = """t AS (SELECT document_id, CASE arg_max(struct_pack(v := validation_status), ingested_at).v WHEN 'accepted' THEN 'reconstructed' WHEN 'rejected' THEN 'model_failure' WHEN 'needs_human_review' THEN 'needs_human_review' ELSE 'unchanged_clean' END AS s FROM model_transformations GROUP BY document_id, transformation_id),
g AS (SELECT document_id, list(s) AS l FROM t GROUP BY 1),
r AS (SELECT source_sha256 AS document_id, CASE WHEN list_contains(l, 'needs_human_review') OR readiness_status = 'human_review_required' THEN 'needs_human_review' WHEN l IS NULL THEN 'unusable' WHEN readiness_status = 'partially_reconstructable' AND list_unique(l) = 1 AND l[1] = 'unchanged_clean' THEN 'partially_reconstructable'
  WHEN list_contains(l, 'model_failure') THEN 'model_failure' WHEN list_unique(l) = 1 AND l[1] = 'unchanged_clean' THEN 'unchanged_clean' ELSE 'reconstructed' END AS status FROM cleaning_sidecars LEFT JOIN g ON g.document_id = source_sha256)"""

SQL = {
    "chunk_collection": f"""WITH {_B}, {_K}, {_DUP}, kept AS (SELECT k.*, row_number() OVER (PARTITION BY k.document_id ORDER BY chunk_index, k.chunk_id) - 1 AS position FROM k LEFT JOIN dup ON dup.document_id = k.document_id AND dup.chunk_id = k.chunk_id WHERE dup.chunk_id IS NULL),
e AS (SELECT document_id, chunk_id, unnest(refs) AS r FROM k), f AS (SELECT e.document_id, e.chunk_id, bool_and(coalesce(block_type IN ('header', 'footer'), false)) AS furniture FROM e JOIN b ON b.document_id = e.document_id AND b.block_id = e.r.block_id GROUP BY 1, 2),
x AS (SELECT kept.document_id, kept.chunk_id, position, list_filter([CASE WHEN {_normal("coalesce(text, '')")} = '' THEN 'empty_normalized_text' END, CASE WHEN n_refs = 0 THEN 'missing_source_references' END, CASE WHEN furniture THEN 'administrative_furniture_only' END, CASE WHEN chunk_type = 'figure_context' AND {_normal("coalesce(text, '')")} = '' THEN 'uncaptioned_asset_without_explanation' END], lambda v: v IS NOT NULL) AS reasons
  FROM kept LEFT JOIN f ON f.document_id = kept.document_id AND f.chunk_id = kept.chunk_id)
SELECT document_id, chunk_id, position, len(reasons) = 0 AS eligible, array_to_string(reasons, ',') AS reasons FROM x""",
    "collection_statistics": f"""WITH {_K}, {_DUP}, {_D}, g AS (SELECT document_id, count(*) AS chunks, min(length(coalesce(text, ''))) AS least, max(length(coalesce(text, ''))) AS most, round(avg(length(coalesce(text, ''))), 4) AS mean, CAST(sum((length(coalesce(text, '')) + 3) // 4) AS BIGINT) AS tokens, round(count(*) FILTER (n_refs > 0) / count(*), 6) AS coverage, count(*) FILTER (n_refs = 0) AS unreferred, count(*) FILTER (el) AS eligible, count(*) FILTER (NOT el) AS excluded FROM k GROUP BY 1),
ty AS (SELECT document_id, string_agg(v, ',' ORDER BY v) AS types FROM (SELECT document_id, coalesce(chunk_type, 'none') || ':' || count(*) AS v FROM k GROUP BY document_id, chunk_type) GROUP BY 1), du AS (SELECT document_id, count(*) AS duplicates FROM dup GROUP BY 1)
SELECT d.document_id, coalesce(chunks, 0) AS chunks, coalesce(least, 0) AS least, coalesce(most, 0) AS most, coalesce(mean, 0.0) AS mean, coalesce(tokens, 0) AS tokens, coalesce(coverage, 0.0) AS coverage, coalesce(unreferred, 0) AS unreferred, coalesce(eligible, 0) AS eligible, coalesce(excluded, 0) AS excluded, coalesce(duplicates, 0) AS duplicates, coalesce(types, '') AS types
FROM d LEFT JOIN g USING (document_id) LEFT JOIN ty USING (document_id) LEFT JOIN du USING (document_id)""",
    "dataset_issues": f"""WITH {_B}, {_K}, {_D}, o AS (SELECT document_id, block_id, coalesce(table_id, asset_id) AS object_id, table_id IS NOT NULL AS is_table FROM b WHERE table_id IS NOT NULL OR asset_id IS NOT NULL), e AS (SELECT document_id, chunk_id, unnest(refs) AS r FROM k)
SELECT document_id, chunk_id AS item, 'chunk_of_unknown_document' AS rule FROM k WHERE document_id NOT IN (SELECT document_id FROM d) UNION ALL SELECT document_id, '', 'document_without_chunks' FROM d WHERE document_id NOT IN (SELECT document_id FROM k)
UNION ALL SELECT min(document_id), chunk_id, 'chunk_id_repeated' FROM k GROUP BY chunk_id HAVING count(*) > 1 UNION ALL SELECT k.document_id, chunk_id, 'source_path_missing' FROM k JOIN d USING (document_id) WHERE k.path IS NULL
UNION ALL SELECT DISTINCT e.document_id, e.chunk_id || '/' || o.object_id, 'object_unknown' FROM e JOIN o ON o.document_id = e.document_id AND o.block_id = e.r.block_id WHERE NOT EXISTS (SELECT 1 FROM o t WHERE t.is_table AND t.document_id = e.document_id AND t.object_id = o.object_id)""",
    "stage_cascade": f"""WITH {_D}, {_K}, c AS (SELECT * FROM k WHERE trim(coalesce(text, ''), ' ') <> ''), f AS (SELECT document_id, document_id IN (SELECT document_id FROM blocks WHERE trim(coalesce(text, ''), ' ') <> '') AS a, document_id IN (SELECT document_id FROM c) AS b, document_id IN (SELECT document_id FROM c WHERE el) AS e,
EXISTS (SELECT 1 FROM cleaning_sidecars s WHERE s.source_sha256 = d.document_id AND s.source_relative_path = d.path) AS v FROM d)
SELECT document_id, CASE WHEN a AND b AND e AND v THEN 'derivative' WHEN a AND b AND e THEN 'dataset' WHEN a AND b THEN 'chunks' WHEN a THEN 'canonical' ELSE 'source' END AS stage, a AND b AND e AND v AS complete FROM f""",
    "export_discovery": f"""WITH {_D}, m AS (SELECT path, max(struct_pack(h := document_id, s := CASE WHEN cls = 'likely_scanned' THEN 'requires_ocr' ELSE 'exported' END)) AS x FROM d GROUP BY 1)
SELECT source_relative_path AS path, CASE WHEN m.path IS NULL THEN 'not_in_manifest' WHEN x.s <> 'exported' THEN 'not_successful' WHEN x.h IS DISTINCT FROM source_sha256 THEN 'hash_differs' ELSE 'ok' END AS state FROM cleaning_sidecars LEFT JOIN m ON m.path = source_relative_path""",
    "eligible_exports": f"WITH {_D} SELECT path AS source_relative_path, max(document_id) AS document_id FROM d WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('pdf', 'pptx') GROUP BY 1 ORDER BY 1 LIMIT 50",
    "export_outcomes": f"WITH {_OUT} SELECT document_id, outcome, tool, characters FROM o",
    "export_summary": f"WITH {_OUT} SELECT outcome, count(*) AS documents, CAST(sum(CASE WHEN outcome IN ('exported', 'exported_with_warnings') THEN characters ELSE 0 END) AS BIGINT) AS characters FROM o GROUP BY 1",
    "character_counts": f"WITH {_B}, {_D} SELECT b.document_id, CAST(sum(CASE WHEN kind = 'pdf' THEN length(coalesce(text, '')) ELSE length({_strip("coalesce(text, '')")}) END) AS BIGINT) AS characters, count(*) FILTER (length({_strip("coalesce(text, '')")}) > 0) AS texts FROM b JOIN d USING (document_id) GROUP BY 1",
    "second_decisions": "SELECT user_id, count(*) AS decisions, arg_min(event_type, struct_pack(t := ts, i := event_id)) AS first_status FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1 HAVING count(*) > 1",
    "export_entries": f"WITH {_OUT} SELECT document_id, sha256(path || chr(1) || document_id || chr(1) || outcome || chr(1) || tool) AS entry_id, kind AS document_type FROM o",
    "reconstruction_states": f"WITH {_RECON} SELECT document_id, status FROM r",
    "preparation_report": f"""WITH {_RECON}, dr AS ({_QUALITIES["document_readiness"]}), cd AS ({_TEXTS["cleaning_decisions"]}), au AS ({_AUDITS["audit_issues"]})
SELECT 'readiness' AS measure, status AS "value", count(*) AS n FROM dr GROUP BY 2 UNION ALL SELECT 'reconstruction', status, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'suppressed', reason, count(*) FROM cd WHERE NOT retained GROUP BY 2 UNION ALL SELECT 'suspicious', code, count(*) FROM au WHERE code LIKE 'unsupported_%' OR code LIKE 'changed_%' GROUP BY 2""",
    "raw_candidates": f"""WITH r AS (SELECT DISTINCT document_id, location_number AS page, block_ordinal AS place, raw_block_id AS block_id, text FROM raw_blocks), k AS (SELECT *, {_strip("text")} AS t, {_key(_strip("text"))} AS k FROM r)
SELECT document_id, page, row_number() OVER (PARTITION BY document_id, page ORDER BY place, block_id) AS ordinal, block_id, length(t) AS characters, md5(k) AS "key" FROM k WHERE k <> ''""",
    "padded_ids": f"WITH {_O} SELECT document_id, block_id, 'block-' || lpad(CAST(ordinal AS VARCHAR), 6, '0') AS padded FROM o",
    "source_references": f"""WITH {_D}, b AS (SELECT document_id, block_id, arg_max(struct_pack(p := page, e := source_excerpt), ingested_at) AS x FROM blocks GROUP BY 1, 2)
SELECT b.document_id, path AS source_relative_path, {_TYPES} AS location_type, CASE WHEN {_TYPES} <> 'document' THEN b.x.p END AS page, block_id, b.x.e AS excerpt FROM b JOIN d USING (document_id)""",
    "accepted_union": "SELECT document_id, transformation_id, x.t AS transformation_type FROM (SELECT document_id, transformation_id, arg_max(struct_pack(t := transformation_type, s := validation_status), ingested_at) AS x FROM model_transformations GROUP BY 1, 2) WHERE x.s = 'accepted'",
    "chunk_lookup": "SELECT chunk_id, x.d AS document_id, x.i AS chunk_index, x.n AS characters FROM (SELECT chunk_id, arg_max(struct_pack(d := document_id, i := chunk_index, n := length(text)), generated_at) AS x FROM chunks WHERE chunk_id = (SELECT min(chunk_id) FROM chunks) GROUP BY 1)",
}
