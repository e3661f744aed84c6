"""Queries on the inventory of files, their states and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import inventory as I
from lectern.operators.selection import event_state
from lectern.sources.tables import latest, table

_ABOUT = ["source_relative_path", "source_extension", "document_type", "title", "language", "page_or_slide_count", "classification", "config_id", "parser_name"]


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "normalized_documents"), ["document_id"], "ingested_at", ["document_id", *_ABOUT])


def inventory_types(spark: SparkSession, folder: str) -> DataFrame:
    d = _documents(spark, folder).withColumn("file_type", I.file_type(F.col("source_relative_path")))
    return d.groupBy("file_type", "classification").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("page_or_slide_count", F.lit(0))).alias("pages"))


def duplicate_files(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").filter("text is not null").select(F.sha2("text", 256).alias("sha256"), "doc_id")
    return I.duplicates(d, "sha256", "doc_id").select("sha256", "copies", F.col("first_name").alias("first_id"), "doc_id")


def included_files(spark: SparkSession, folder: str) -> DataFrame:
    d = _documents(spark, folder)
    return I.included(d, "source_relative_path", "page_or_slide_count", ["pdf", "docx"], ["*/renal/*", "campus-*"], 6).select("document_id", "source_relative_path")


def ordered_files(spark: SparkSession, folder: str) -> DataFrame:
    """The first hundred files of the library's order (a report of fixed length)."""
    rank = F.when(F.col("source_extension") == ".pdf", 0).when(F.col("source_extension") == ".pptx", 1).otherwise(2)
    return _documents(spark, folder).orderBy(F.lower("source_relative_path"), rank, "document_id").select("document_id", "source_relative_path").limit(100)


def representative_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty files that show every kind (a report of fixed length)."""
    d = _documents(spark, folder)
    kind = F.when(F.col("source_extension") == ".pdf", F.concat(F.lit("pdf-"), F.col("classification"))).otherwise(F.col("source_extension"))
    return I.representatives(d, kind, ["source_relative_path", "document_id"], 20).select("document_id", "source_relative_path")


def manifest_reuse(spark: SparkSession, folder: str) -> DataFrame:
    live = _documents(spark, folder).select("document_id", "source_relative_path", F.col("language").alias("detected_language"))
    cached = table(spark, folder, "cleaning_sidecars").select(F.col("source_sha256").alias("document_id"), "source_relative_path", "detected_language")
    return I.reuse(live, cached, "document_id", ["source_relative_path", "detected_language"]).select("document_id", "state")


def snapshot_diff(spark: SparkSession, folder: str) -> DataFrame:
    before = table(spark, folder, "cleaning_sidecars").select("source_relative_path", F.col("readiness_status").alias("status"))
    after = _documents(spark, folder).select("source_relative_path", F.when(F.col("classification") == "likely_scanned", "partially_reconstructable").otherwise("ready").alias("status"))
    one = lambda df: df.groupBy("source_relative_path").agg(F.max("status").alias("status"))
    return I.changes(one(before), one(after), "source_relative_path", "status")


def output_path_collisions(spark: SparkSession, folder: str) -> DataFrame:
    d = _documents(spark, folder).select(F.regexp_replace("source_relative_path", r"-\d+\.", ".").alias("path"), "document_id")
    return I.target_paths(d, "path", "document_id")


def ocr_quality(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "raw_blocks").select("document_id", "raw_block_id", F.col("location_number").alias("page"), "text").distinct().groupBy("document_id", "page").agg(F.sum(F.length("text")).alias("before"))
    keys = ["document_id", "block_id"]
    sized = table(spark, folder, "blocks").select(*keys, "page", F.length("text").alias("size"), "ingested_at")
    made = latest(sized, keys, "ingested_at").groupBy("document_id", "page").agg(F.sum("size").alias("after"))
    return I.scan_metrics(raw.join(made, ["document_id", "page"], "left"))


def derivative_choice(spark: SparkSession, folder: str) -> DataFrame:
    """The derivative (here: transformation) used for each original text of a document: the lowest id, and whether there was a choice."""
    keys = ["document_id", "transformation_id"]
    hashed = table(spark, folder, "model_transformations").filter("validation_status = 'accepted' and original_text is not null").select(*keys, F.sha2("original_text", 256).alias("sha256"))
    return I.lowest(hashed, ["document_id", "sha256"], "transformation_id")


def batch_histograms(spark: SparkSession, folder: str) -> DataFrame:
    d = _documents(spark, folder).withColumn("source", F.split("source_relative_path", "/")[0])
    sets = [["classification"], ["document_type"], ["config_id"], ["source"], []]
    name = F.when(F.grouping("classification") == 0, "classification").when(F.grouping("document_type") == 0, "document_type").when(F.grouping("config_id") == 0, "config_id").when(F.grouping("source") == 0, "source").otherwise("all")
    g = d.groupingSets([[F.col(c) for c in s] for s in sets], "classification", "document_type", "config_id", "source")
    return g.agg(name.alias("dimension"), F.count(F.lit(1)).alias("files"), F.sum("page_or_slide_count").alias("pages")).select("dimension", F.coalesce("classification", "document_type", "config_id", "source").alias("value"), "files", "pages")


def latest_stage(spark: SparkSession, folder: str) -> DataFrame:
    return event_state(table(spark, folder, "events"), "user_id", "ts", "event_id", "event_type")


def stage_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return latest_stage(spark, folder).groupBy("status").agg(F.count(F.lit(1)).alias("users"), F.sum("n_events").alias("events"), F.max("n_events").alias("most"))


def sample_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Ten small files of every kind (a report of fixed length)."""
    kind = F.when(F.col("classification") == "native_text", "native").when(F.col("classification").isin("mixed", "likely_scanned"), "image").otherwise("office")
    return I.samples(_documents(spark, folder), kind, "page_or_slide_count", ["source_relative_path", "document_id"], 10).select("document_id", "source_relative_path")


def difficulty_mix(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    return n.select("source", "documents", I.thirds(F.col("documents")).alias("t")).select("source", "documents", *[F.col(f"t.{k}").cast("bigint").alias(k) for k in ("easy", "medium", "hard")])


QUERIES = {f.__name__: f for f in (inventory_types, duplicate_files, included_files, ordered_files, representative_selection, manifest_reuse, snapshot_diff, output_path_collisions, ocr_quality, derivative_choice, batch_histograms, latest_stage, stage_rollup, sample_selection, difficulty_mix)}

_D = f"d AS (SELECT document_id, s.* FROM (SELECT document_id, arg_max(struct_pack({', '.join(f'{c} := {c}' for c in _ABOUT)}), ingested_at) AS s FROM normalized_documents GROUP BY 1))"
_KNOWN = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in I.FILE_TYPES.items()) + "}"
_FIRST = "row_number() OVER (PARTITION BY CASE WHEN source_extension = '.pdf' THEN 'pdf-' || classification ELSE source_extension END ORDER BY source_relative_path, document_id)"
_STATE = "SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS status, count(*) AS n_events, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1"

SQL = {
    "inventory_types": f"WITH {_D} SELECT coalesce({_KNOWN}[lower(regexp_extract(source_relative_path, '\\.([^./]+)$', 1))], 'Unknown') AS file_type, classification, count(*) AS files, CAST(sum(coalesce(page_or_slide_count, 0)) AS BIGINT) AS pages FROM d GROUP BY 1, 2",
    "duplicate_files": "WITH t AS (SELECT sha256(text) AS sha256, doc_id FROM documents WHERE text IS NOT NULL), g AS (SELECT sha256, count(*) AS copies, min(doc_id) AS first_id FROM t GROUP BY 1 HAVING count(*) > 1) SELECT sha256, copies, first_id, doc_id FROM t JOIN g USING (sha256)",
    "included_files": f"WITH {_D} SELECT document_id, source_relative_path FROM d WHERE regexp_extract(source_relative_path, '\\.([^./]+)$', 1) IN ('pdf', 'docx') AND source_relative_path NOT LIKE '%/renal/%' AND source_relative_path NOT LIKE 'campus-%' AND page_or_slide_count <= 6",
    "ordered_files": f"WITH {_D} SELECT document_id, source_relative_path FROM d ORDER BY lower(source_relative_path), CASE source_extension WHEN '.pdf' THEN 0 WHEN '.pptx' THEN 1 ELSE 2 END, document_id LIMIT 100",
    "representative_selection": f"WITH {_D}, r AS (SELECT *, CASE WHEN {_FIRST} = 1 THEN 0 ELSE 1 END AS later FROM d) SELECT document_id, source_relative_path FROM r ORDER BY later, source_relative_path, document_id LIMIT 20",
    "manifest_reuse": f"WITH {_D} SELECT d.document_id, CASE WHEN c.source_sha256 IS NULL THEN 'new' WHEN d.source_relative_path IS NOT DISTINCT FROM c.source_relative_path AND d.language IS NOT DISTINCT FROM c.detected_language THEN 'current' ELSE 'stale' END AS state FROM d LEFT JOIN cleaning_sidecars c ON c.source_sha256 = d.document_id",
    "snapshot_diff": f"""WITH {_D}, b AS (SELECT source_relative_path, max(readiness_status) AS s FROM cleaning_sidecars GROUP BY 1),
a AS (SELECT source_relative_path, max(CASE WHEN classification = 'likely_scanned' THEN 'partially_reconstructable' ELSE 'ready' END) AS s FROM d GROUP BY 1)
SELECT coalesce(a.source_relative_path, b.source_relative_path) AS source_relative_path, CASE WHEN b.source_relative_path IS NULL THEN 'added' WHEN a.source_relative_path IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM b FULL JOIN a USING (source_relative_path) WHERE b.source_relative_path IS NULL OR a.source_relative_path IS NULL OR a.s IS DISTINCT FROM b.s""",
    "output_path_collisions": rf"""WITH {_D}, f AS (SELECT regexp_replace(source_relative_path, '-\d+\.', '.') AS path, document_id FROM d),
t AS (SELECT path, regexp_replace(path, '\.[^./]+$', '') || '.txt' AS a, regexp_replace(path, '\.[^./]+$', '') || '__' || regexp_extract(path, '\.([^./]+)$', 1) || '.txt' AS b, regexp_replace(path, '\.[^./]+$', '') || '__' || regexp_extract(path, '\.([^./]+)$', 1) || '__' || document_id[1:12] || '.txt' AS c FROM f),
n AS (SELECT *, count(*) OVER (PARTITION BY lower(a)) AS na, count(*) OVER (PARTITION BY lower(b)) AS nb, count(*) OVER (PARTITION BY lower(c)) AS nc FROM t) SELECT path, CASE WHEN na = 1 THEN a WHEN nb = 1 THEN b WHEN nc = 1 THEN c END AS target FROM n""",
    "ocr_quality": """WITH r AS (SELECT document_id, location_number AS page, sum(length(text)) AS before FROM (SELECT DISTINCT document_id, raw_block_id, location_number, text FROM raw_blocks) GROUP BY 1, 2),
b AS (SELECT document_id, x.page AS page, sum(length(x.text)) AS after FROM (SELECT document_id, block_id, arg_max(struct_pack(page := page, text := text), ingested_at) AS x FROM blocks GROUP BY 1, 2) GROUP BY 1, 2),
p AS (SELECT document_id, count(*) AS pages, CAST(sum(coalesce(before, 0)) AS BIGINT) AS before, CAST(sum(coalesce(after, 0)) AS BIGINT) AS after, count(*) FILTER (coalesce(before, 0) < 100) AS low_pages, count(*) FILTER (coalesce(after, 0) < 100) AS low_after, count(*) FILTER (before IS NULL OR after IS NULL) AS odd FROM r LEFT JOIN b USING (document_id, page) GROUP BY 1)
SELECT document_id, pages, before, after, low_pages, round((after - before) * 100.0::DOUBLE / nullif(before, 0), 4) AS gain, CASE WHEN odd > 0 THEN 'invalid' WHEN after < 0.9 * before THEN 'degraded' WHEN after - before < 50 AND coalesce((after - before) * 100.0::DOUBLE / nullif(before, 0), 0) < 25 THEN 'no_material_improvement' WHEN low_after > 0 THEN 'accepted_with_warnings' ELSE 'accepted' END AS outcome FROM p""",
    "derivative_choice": "SELECT document_id, sha256(original_text) AS sha256, min(transformation_id) AS transformation_id, count(DISTINCT transformation_id) AS choices FROM model_transformations WHERE validation_status = 'accepted' AND original_text IS NOT NULL GROUP BY 1, 2",
    "batch_histograms": f"""WITH {_D}, s AS (SELECT *, split_part(source_relative_path, '/', 1) AS source FROM d)
SELECT CASE WHEN grouping(classification) = 0 THEN 'classification' WHEN grouping(document_type) = 0 THEN 'document_type' WHEN grouping(config_id) = 0 THEN 'config_id' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS dimension,
coalesce(classification, document_type, config_id, source) AS "value", count(*) AS files, CAST(sum(page_or_slide_count) AS BIGINT) AS pages FROM s GROUP BY GROUPING SETS ((classification), (document_type), (config_id), (source), ())""",
    "latest_stage": _STATE,
    "stage_rollup": f"SELECT status, count(*) AS users, CAST(sum(n_events) AS BIGINT) AS events, max(n_events) AS most FROM ({_STATE}) GROUP BY 1",
    "sample_selection": f"""WITH {_D}, k AS (SELECT *, CASE WHEN classification = 'native_text' THEN 'native' WHEN classification IN ('mixed', 'likely_scanned') THEN 'image' ELSE 'office' END AS kind, coalesce(page_or_slide_count, 2147483647) AS n FROM d),
r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY kind ORDER BY n, source_relative_path, document_id) = 1 THEN 0 ELSE 1 END AS later FROM k) SELECT document_id, source_relative_path FROM r ORDER BY later, n, source_relative_path, document_id LIMIT 10""",
    "difficulty_mix": "SELECT source, n AS documents, n // 3 + CASE WHEN n % 3 >= 2 THEN 1 ELSE 0 END AS easy, n // 3 + CASE WHEN n % 3 >= 1 THEN 1 ELSE 0 END AS medium, n // 3 AS hard FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)",
}
