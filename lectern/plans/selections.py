"""Queries that rank, choose under budgets, compare and roll up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import selection as C
from lectern.plans.structures import _C, _chunks
from lectern.plans.texts import _claims, pairs
from lectern.sources.tables import latest, table

#: Kinds of chunks from the most to the least useful, and strengths of states.
KINDS = ["paragraph_group", "table_context", "list", "section", "subsection", "document_preamble", "orphan_content", "formula_context", "figure_context"]
STATES = {"rejected": 1, "needs_human_review": 2, "accepted": 3}
TERMS = ["diagnostic", "suivi"]


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    c = _chunks(spark, folder, "chunk_index", "chunk_type", "text", "normalized_text_hash", "section_path").filter("text is not null and trim(text) <> ''")
    kind = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("chunk_type")), F.lit(0))
    return c.select(
        "document_id", "chunk_id", "chunk_index", F.length("text").cast("bigint").alias("characters"), F.col("normalized_text_hash").alias("hash"), (-C.topic_matches(TERMS, "section_path")).alias("minus_matches"),
        F.when(F.length("text") >= 100, 0).otherwise(1).alias("thin"), F.when(kind == 0, 99).otherwise(kind).cast("int").alias("kind"),
    )


def topic_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best chunks for the topic (a report of fixed length)."""
    return _ranked(spark, folder).orderBy("minus_matches", "thin", "kind", "document_id", "chunk_index", "chunk_id").limit(10).select("document_id", "chunk_id", (-F.col("minus_matches")).alias("matches"))


def budgeted_selection(spark: SparkSession, folder: str) -> DataFrame:
    b = C.BUDGET
    s = C.budgeted(_ranked(spark, folder), ["document_id"], ["minus_matches", "thin", "kind", "chunk_index", "chunk_id"], "characters", "hash", b["items"], b["characters"], b["tokens"])
    return s.select("document_id", "chunk_id", "reason")


def course_units(spark: SparkSession, folder: str) -> DataFrame:
    c = _chunks(spark, folder, "eligible", "text", "source_relative_path").withColumn("n", F.length(F.coalesce("text", F.lit(""))))
    reason = F.when(~F.col("eligible"), "chunk_ineligible").when(F.col("n") < 100, "below_minimum_characters").otherwise("eligible")
    return c.groupBy("document_id", reason.alias("reason")).agg(F.count(F.lit(1)).alias("units"), F.sum("n").alias("characters"))


def coverage_priority(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["document_id", "transformation_id"]
    t = latest(table(spark, folder, "model_transformations"), keys, "ingested_at", [*keys, "validation_status", "model_tag"])
    return C.strongest(t, ["document_id"], "validation_status", STATES, {"model_tag": "models"})


def coverage_ledger(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "normalized_documents").select("document_id").distinct()
    state = F.when(F.col("validation_status") == "accepted", "covered").when(F.col("validation_status") == "rejected", "failed").when(F.col("validation_status").isNotNull(), "needs_revision").otherwise("pending")
    return docs.join(coverage_priority(spark, folder), "document_id", "left").groupBy(state.alias("coverage")).agg(F.count(F.lit(1)).alias("documents"))


def near_duplicate_pairs(spark: SparkSession, folder: str) -> DataFrame:
    p = pairs(spark, folder).select("document_id", "transformation_id", X.claim_words(F.coalesce("reconstructed_text", F.lit(""))).alias("words"))
    return C.similar_sets(p, "document_id", "transformation_id", "words", 0.85)


def best_transformation(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["document_id", "transformation_id"]
    t = latest(table(spark, folder, "model_transformations"), keys, "ingested_at", [*keys, "validation_status", "confidence", "transformation_type"])
    order = [F.col("validation_status") == "accepted", F.col("confidence")]
    return C.best(t, ["document_id"], order, ["transformation_id", "transformation_type"])


def first_issue(spark: SparkSession, folder: str) -> DataFrame:
    """The first chunk of a document whose stated length is not that of its text."""
    c = _chunks(spark, folder, "chunk_index", "text", "character_count")
    return c.filter(~F.col("character_count").eqNullSafe(F.length(F.coalesce("text", F.lit(""))))).groupBy("document_id").agg(F.min("chunk_index").alias("first_index"), F.count(F.lit(1)).alias("issues"))


QUERIES = {f.__name__: f for f in (topic_rank, budgeted_selection, course_units, coverage_priority, coverage_ledger, near_duplicate_pairs, best_transformation, first_issue)}

_KIND = "coalesce(nullif(coalesce(list_position([" + ", ".join(f"'{k}'" for k in KINDS) + "], chunk_type), 0), 0), 99)"
_MATCH = " + ".join(f"CASE WHEN contains(lower(coalesce(array_to_string(section_path, ' '), '')), '{t}') THEN 1 ELSE 0 END" for t in TERMS)
_RANKED = f"{_C}, hh AS (SELECT document_id, chunk_id, arg_max(normalized_text_hash, generated_at) AS hash FROM chunks GROUP BY 1, 2), k AS (SELECT c.document_id, c.chunk_id, chunk_index, length(text) AS n, hash, {_MATCH} AS matches, CASE WHEN length(text) >= 100 THEN 0 ELSE 1 END AS thin, {_KIND} AS kind FROM c JOIN hh USING (document_id, chunk_id) WHERE text IS NOT NULL AND trim(text, ' ') <> '')"
_T = "t AS (SELECT document_id, transformation_id, x.* FROM (SELECT document_id, transformation_id, arg_max(struct_pack(s := validation_status, m := model_tag, r := reconstructed_text), ingested_at) AS x FROM model_transformations GROUP BY 1, 2))"
_RANK = "CASE s WHEN 'rejected' THEN 1 WHEN 'needs_human_review' THEN 2 WHEN 'accepted' THEN 3 ELSE 0 END"
_PRIORITY = f"SELECT document_id, max(struct_pack(r := {_RANK}, s := s)).s AS validation_status, array_to_string(list_sort(list_distinct(list(m))), ',') AS models FROM t GROUP BY 1"
_B = C.BUDGET

SQL = {
    "topic_rank": f"WITH {_RANKED} SELECT document_id, chunk_id, CAST(matches AS INTEGER) AS matches FROM k ORDER BY -matches, thin, kind, document_id, chunk_index, chunk_id LIMIT 10",
    "budgeted_selection": f"""WITH RECURSIVE {_RANKED}, r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY -matches, thin, kind, chunk_index, chunk_id) AS rn FROM k),
s AS (SELECT document_id, 0::BIGINT AS rn, '' AS chunk_id, '' AS reason, []::VARCHAR[] AS taken, 0::BIGINT AS used, 0::BIGINT AS spent FROM (SELECT DISTINCT document_id FROM r)
  UNION ALL
  SELECT r.document_id, r.rn, r.chunk_id, CASE WHEN list_contains(taken, hash) THEN 'duplicate' WHEN len(taken) >= {_B["items"]} THEN 'enough_items' WHEN used + n > {_B["characters"]} OR spent + (n + 3) // 4 > {_B["tokens"]} THEN 'over_budget' ELSE 'selected' END,
    CASE WHEN NOT list_contains(taken, hash) AND len(taken) < {_B["items"]} AND used + n <= {_B["characters"]} AND spent + (n + 3) // 4 <= {_B["tokens"]} THEN list_append(taken, hash) ELSE taken END, CASE WHEN NOT list_contains(taken, hash) AND len(taken) < {_B["items"]} AND used + n <= {_B["characters"]} AND spent + (n + 3) // 4 <= {_B["tokens"]} THEN used + n ELSE used END, CASE WHEN NOT list_contains(taken, hash) AND len(taken) < {_B["items"]} AND used + n <= {_B["characters"]} AND spent + (n + 3) // 4 <= {_B["tokens"]} THEN spent + (n + 3) // 4 ELSE spent END
  FROM r JOIN s ON r.document_id = s.document_id AND r.rn = s.rn + 1)
SELECT document_id, chunk_id, reason FROM s WHERE rn > 0""",
    "course_units": f"WITH {_C} SELECT document_id, CASE WHEN NOT eligible THEN 'chunk_ineligible' WHEN length(coalesce(text, '')) < 100 THEN 'below_minimum_characters' ELSE 'eligible' END AS reason, count(*) AS units, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS characters FROM c GROUP BY 1, 2",
    "coverage_priority": f"WITH {_T} {_PRIORITY}",
    "coverage_ledger": f"""WITH {_T}, p AS ({_PRIORITY}) SELECT CASE WHEN validation_status = 'accepted' THEN 'covered' WHEN validation_status = 'rejected' THEN 'failed' WHEN validation_status IS NOT NULL THEN 'needs_revision' ELSE 'pending' END AS coverage, count(*) AS documents
FROM (SELECT DISTINCT document_id FROM normalized_documents) LEFT JOIN p USING (document_id) GROUP BY 1""",
    "near_duplicate_pairs": f"""WITH {_T}, w AS (SELECT document_id, transformation_id, list_sort({_claims("coalesce(r, '')")}) AS ws FROM t),
h AS (SELECT document_id, ws, min(transformation_id) AS k FROM w WHERE len(ws) > 0 GROUP BY 1, 2),
near AS (SELECT a.document_id, a.k AS left_key, b.k AS right_key, round(len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))), 6) AS similarity FROM h a JOIN h b ON a.document_id = b.document_id AND a.k < b.k WHERE len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) >= 0.85)
SELECT * FROM near UNION ALL SELECT w.document_id, h.k, w.transformation_id, 1.0 FROM w JOIN h ON w.document_id = h.document_id AND w.ws = h.ws WHERE w.transformation_id <> h.k""",
    "best_transformation": """WITH t AS (SELECT document_id, transformation_id, x.* FROM (SELECT document_id, transformation_id, arg_max(struct_pack(s := validation_status, c := confidence, ty := transformation_type), ingested_at) AS x FROM model_transformations GROUP BY 1, 2)),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY s = 'accepted' DESC NULLS LAST, c DESC NULLS LAST, transformation_id DESC) AS rn FROM t) SELECT document_id, transformation_id, ty AS transformation_type FROM r WHERE rn = 1""",
    "first_issue": f"WITH {_C}, n AS (SELECT document_id, chunk_id, arg_max(struct_pack(v := character_count), generated_at).v AS stated FROM chunks GROUP BY 1, 2) SELECT document_id, min(chunk_index) AS first_index, count(*) AS issues FROM c JOIN n USING (document_id, chunk_id) WHERE stated IS DISTINCT FROM length(coalesce(text, '')) GROUP BY 1",
}
