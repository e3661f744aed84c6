"""Queries on integrity and on how far pages can be used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import quality as Q
from lectern.operators.cleaning import clean_pages
from lectern.plans.structures import _B, _blocks, _chunks
from lectern.plans.texts import _CLEANING, _SPACE, _normal
from lectern.sources.tables import latest, table


def integrity_issues(spark: SparkSession, folder: str) -> DataFrame:
    b = _blocks(spark, folder, "block_type", "page", "reading_order", "section_id", "table_id", F.col("text").isNull().alias("no_text"))
    s = latest(table(spark, folder, "sections"), ["document_id", "section_id"], "ingested_at", ["document_id", "section_id", "parent_section_id", "title"])
    d = table(spark, folder, "normalized_documents").select("document_id").distinct()
    parts = [
        Q.missing_targets(b, ["block_id"], "section_id", s, "section_id", ["document_id"], "block_section_missing"),
        Q.missing_targets(s, ["section_id"], "parent_section_id", s, "section_id", ["document_id"], "parent_section_missing"),
        Q.missing_targets(b.withColumn("own", F.col("document_id")), ["block_id"], "own", d.withColumn("target", F.col("document_id")), "target", ["document_id"], "block_document_missing"),
        Q.broken(b, "document_id", F.col("block_id"), {"text_missing": F.col("no_text"), "page_missing": F.col("page").isNull(), "page_not_positive": F.col("page") < 1, "table_without_id": (F.col("block_type") == "table") & F.col("table_id").isNull()}),
        Q.repeated_keys(b, "document_id", ["page", "reading_order"], "reading_order_repeated"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chunk_checks(spark: SparkSession, folder: str) -> DataFrame:
    c = _chunks(spark, folder, "chunk_index", "text", "character_count", "token_estimate", "eligible", "exclusion_reasons", "refs", "normalized_text_hash")
    n = F.length(F.coalesce("text", F.lit("")))
    rules = {
        "character_count": ~F.col("character_count").eqNullSafe(n), "token_estimate": F.col("token_estimate") != X.token_estimate(n), "eligible_with_reasons": F.col("eligible") & (F.size("exclusion_reasons") > 0), "ineligible_without_reasons": ~F.col("eligible") & (F.coalesce(F.size("exclusion_reasons"), F.lit(0)) == 0), "text_hash_differs": F.col("normalized_text_hash") != X.text_hash(F.coalesce("text", F.lit(""))), "no_references": F.coalesce(F.size("refs"), F.lit(0)) == 0,
        "repeated_block": F.size(F.array_distinct("refs.block_id")) < F.size("refs.block_id"), "no_text": n == 0,
    }
    return Q.broken(c, "document_id", F.col("chunk_id"), rules).unionByName(Q.numbering_gaps(c, "document_id", "chunk_index", "index_not_contiguous"))


def issue_rollup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "normalized_documents").select("document_id").distinct()
    i = chunk_checks(spark, folder).groupBy("document_id").agg(F.count(F.lit(1)).alias("issues"), F.count_if(F.col("rule").isin("no_text", "index_not_contiguous")).alias("errors"))
    status = F.when(F.col("errors") > 0, "failed").when(F.col("issues") > 0, "needs_revision").otherwise("success")
    return docs.join(i, "document_id", "left").select("document_id", F.coalesce("issues", F.lit(0)).alias("issues"), status.alias("status"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """Readiness of every page of raw text, with its cleaned text and the blocks dropped from it."""
    r = table(spark, folder, "raw_blocks").select("document_id", F.col("raw_block_id").alias("block_id"), F.col("location_number").alias("page"), F.col("block_ordinal").alias("place"), "text").distinct()
    c = clean_pages(r).select("document_id", "block_id", "ordinal", F.col("text").alias("clean"), "retained", (F.col("transformation") == "duplicate_suppression").alias("dropped"))
    row = F.struct("ordinal", "text", F.when(F.col("retained") & (F.col("clean") != ""), F.col("clean")).alias("clean"))
    g = r.join(c, ["document_id", "block_id"]).groupBy("document_id", "page").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.count_if("dropped").alias("burden"))
    return Q.readiness(g.select("document_id", "page", F.array_join("rows.text", "\n\n").alias("raw"), F.array_join("rows.clean", "\n\n").alias("cleaned"), F.col("rows.text").alias("blocks"), "burden"))


def location_readiness(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder)


def document_readiness(spark: SparkSession, folder: str) -> DataFrame:
    return Q.document_readiness(_pages(spark, folder))


QUERIES = {f.__name__: f for f in (integrity_issues, chunk_checks, issue_rollup, location_readiness, document_readiness)}

_CHECKS = f"""ck AS (SELECT document_id, chunk_id, arg_max(struct_pack(text := text, cc := character_count, te := token_estimate, el := eligible, er := exclusion_reasons, refs := refs, ix := chunk_index, nh := normalized_text_hash), generated_at) AS s FROM chunks GROUP BY 1, 2),
cc AS (SELECT document_id, chunk_id, s.*, length(coalesce(s.text, '')) AS n FROM ck),
issues AS (SELECT document_id, chunk_id AS item, 'character_count' AS rule FROM cc WHERE cc IS DISTINCT FROM n UNION ALL SELECT document_id, chunk_id, 'token_estimate' FROM cc WHERE te <> (n + 3) // 4 UNION ALL SELECT document_id, chunk_id, 'eligible_with_reasons' FROM cc WHERE el AND len(er) > 0
UNION ALL SELECT document_id, chunk_id, 'ineligible_without_reasons' FROM cc WHERE NOT el AND coalesce(len(er), 0) = 0 UNION ALL SELECT document_id, chunk_id, 'text_hash_differs' FROM cc WHERE nh <> sha256({_normal("coalesce(text, '')")}) UNION ALL SELECT document_id, chunk_id, 'no_references' FROM cc WHERE coalesce(len(refs), 0) = 0
UNION ALL SELECT document_id, chunk_id, 'repeated_block' FROM cc WHERE len(list_distinct(list_transform(refs, lambda r: r.block_id))) < len(refs) UNION ALL SELECT document_id, chunk_id, 'no_text' FROM cc WHERE n = 0
UNION ALL SELECT document_id, '', 'index_not_contiguous' FROM cc GROUP BY 1 HAVING min(ix) <> 0 OR max(ix) <> count(*) - 1 OR count(DISTINCT ix) <> count(*))"""

_W = "[^\\p{L}\\p{N}_]"
_SCANNED = f"(?i)(^|{_W})(?:CamScanner|Scanned[\\t\\n\\x0b\\f\\r ]+with|scanner)({_W}|$)"
_READINESS = f"""{_CLEANING}, rw AS (SELECT DISTINCT document_id, raw_block_id AS block_id, text AS raw FROM raw_blocks),
pw0 AS (SELECT d.document_id, d.page, coalesce(string_agg(rw.raw, chr(10) || chr(10) ORDER BY ordinal), '') AS raw, coalesce(string_agg(d.text, chr(10) || chr(10) ORDER BY ordinal) FILTER (reason IS NULL AND d.text <> ''), '') AS cleaned, list(rw.raw ORDER BY ordinal) AS blocks, count(*) FILTER (reason IS NOT NULL) AS burden FROM done d JOIN rw USING (document_id, block_id) GROUP BY 1, 2),
pw1 AS (SELECT *, regexp_replace(regexp_replace(cleaned, '{_SCANNED}', '\\1\\2', 'g'), '^[ \\-|\\n\\t]+|[ \\-|\\n\\t]+$', '', 'g') AS body, list_transform(list_filter(blocks, lambda x: trim(coalesce(x, ''), ' ') <> ''), lambda x: regexp_replace(regexp_replace(x, '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g')) AS vs,
  list_filter(list_transform(string_split(replace(replace(raw, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda x: x <> '') AS ls FROM pw0),
pw2 AS (SELECT *, length(body) AS n, regexp_extract_all(body, '\\p{{L}}+') AS w, regexp_matches(raw, '{_SCANNED}') AS scanned, regexp_matches(raw, '(?i)(?:^|{_W})(?:figure|fig\\.|sch[ée]ma|image|radiographie|scanner|photo)') AS captioned,
  len(regexp_extract_all(body, '\\p{{L}}')) AS letters, len(regexp_extract_all(body, '\\p{{Lu}}')) AS uppers, len(regexp_extract_all(body, '[^\\t\\n\\x0b\\f\\r ]')) AS solid FROM pw1),
pw AS (SELECT *, len(w) AS words, n > 0 AND (coalesce(letters / nullif(solid, 0), 0) < 0.35 OR coalesce(len(list_filter(w, lambda x: length(x) = 1)) / nullif(len(w), 0), 1.0) > 0.35 OR coalesce(len(list_filter(regexp_extract_all(body, '[\\p{{S}}\\p{{Cc}}]'), lambda x: NOT regexp_matches(x, '[\\t\\n\\x0b\\f\\r ]'))) / nullif(solid, 0), 0) > 0.2
    OR (n < 100 AND len(w) < 12 AND coalesce(list_max(list_transform(w, lambda x: length(x))), 0) < 5)) AS gibberish, len(blocks) <= 2 AND coalesce(uppers / nullif(letters, 0), 0) >= 0.5 AS titled,
  regexp_matches(raw, '&[A-Za-z]{{3,}}|\\x{{FFFD}}|\\x00|(?:^|{_W})[A-Za-z][\\t\\n\\x0b\\f\\r ]+[A-Za-z][\\t\\n\\x0b\\f\\r ]+[A-Za-z][\\t\\n\\x0b\\f\\r ]+[A-Za-z](?:{_W}|$)') AS font, regexp_matches(raw, '(?i)(?:^|{_W})\\p{{Nd}}+[\\t\\n\\x0b\\f\\r ]{{2,}}(?:e[\\t\\n\\x0b\\f\\r ]*)?\\p{{Nd}}+(?:{_W}|$)') AS ambiguous,
  regexp_matches(raw, '(?i)(?:^|{_W})(?:arbre|algorithme|conduite[\\t\\n\\x0b\\f\\r ]+[àa][\\t\\n\\x0b\\f\\r ]+tenir|cause[\\t\\n\\x0b\\f\\r ]+[ée]vidente)(?:{_W}|$)') OR (len(list_filter(ls, lambda x: length(x) <= 24)) >= 10 AND len(list_filter(ls, lambda x: length(x) >= 80)) = 0 AND len(list_filter(ls, lambda x: regexp_matches(x, '^[-•\uf0b7]'))) * 2 < len(ls)) AS flat,
  contains(raw, '===== TABLE') AND NOT contains(raw, '|') AS detached, len(list_filter(range(1, len(vs)), lambda i: length(vs[i]) >= 25 AND NOT regexp_matches(vs[i], '^-|^===== TABLE') AND NOT regexp_matches(vs[i], '[.:;?!)]$') AND regexp_matches(vs[i + 1], '^\\p{{Ll}}'))) AS fragments,
  len(list_filter(vs, lambda x: regexp_matches(x, '^(?:I{{1,4}}|IV|V|VI{{0,3}}|IX|X)[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]'))) > 0 AS malformed FROM pw2),
s1 AS (SELECT *, CASE WHEN font THEN 'human_review_required' WHEN gibberish THEN CASE WHEN words < 12 THEN 'unusable' ELSE 'human_review_required' END WHEN n < 20 THEN CASE WHEN scanned OR captioned THEN 'image_dependent' ELSE 'unusable' END WHEN n < 80 AND NOT titled THEN 'partially_reconstructable' ELSE 'ready' END AS st FROM pw),
s2 AS (SELECT *, CASE WHEN st = 'ready' AND ambiguous THEN 'ready_with_noise' ELSE st END AS st2 FROM s1),
s3 AS (SELECT *, CASE WHEN st2 IN ('ready', 'ready_with_noise') AND captioned AND n < 500 THEN 'image_dependent' WHEN st2 = 'ready' AND flat THEN 'partially_reconstructable' WHEN st2 = 'ready' AND (detached OR burden > 0 OR fragments >= 2 OR malformed) THEN 'ready_with_noise' ELSE st2 END AS status,
  list_sort(list_filter([CASE WHEN scanned THEN 'scanner_watermark' END, CASE WHEN n < 20 THEN 'sparse_or_empty_location' END, CASE WHEN n BETWEEN 20 AND 79 AND titled THEN 'title_only_location' END, CASE WHEN n BETWEEN 20 AND 79 AND NOT titled THEN 'sparse_location' END, CASE WHEN gibberish THEN 'probable_ocr_gibberish' END, CASE WHEN font THEN 'broken_font_or_character_mapping' END, CASE WHEN ambiguous THEN 'ambiguous_numerical_notation' END,
  CASE WHEN captioned AND n < 500 THEN 'caption_without_recoverable_visual_content' END, CASE WHEN flat THEN 'probable_flattened_flowchart_or_spatial_layout' END, CASE WHEN detached THEN 'empty_or_detached_table' END, CASE WHEN burden > 0 THEN 'duplicate_extraction_burden' END, CASE WHEN fragments >= 2 THEN 'broken_sentence_fragments' END, CASE WHEN malformed THEN 'malformed_heading' END], lambda x: x IS NOT NULL)) AS reasons FROM s2)
"""

SQL = {
    "location_readiness": _READINESS + "SELECT document_id, page, status, array_to_string(reasons, ',') AS reasons FROM s3",
    "document_readiness": _READINESS
    + """, g AS (SELECT document_id, count(*) AS pages, count(*) FILTER (status NOT IN ('unusable', 'image_dependent')) AS usable, list(status) AS l FROM s3 GROUP BY 1)
SELECT document_id, pages, usable, CASE WHEN usable = 0 THEN CASE WHEN list_contains(l, 'image_dependent') THEN 'image_dependent' ELSE 'unusable' END WHEN list_contains(l, 'human_review_required') THEN 'human_review_required' WHEN list_contains(l, 'unusable') OR list_contains(l, 'image_dependent') OR list_contains(l, 'partially_reconstructable') THEN 'partially_reconstructable'
WHEN list_contains(l, 'ready_with_noise') THEN 'ready_with_noise' ELSE 'ready' END AS status FROM g""",
    "integrity_issues": f"""WITH {_B}, s AS (SELECT document_id, section_id, arg_max(struct_pack(p := parent_section_id), ingested_at).p AS p FROM sections GROUP BY 1, 2), d AS (SELECT DISTINCT document_id FROM normalized_documents)
SELECT document_id, block_id AS item, 'block_section_missing' AS rule FROM b WHERE section_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s WHERE s.document_id = b.document_id AND s.section_id = b.section_id)
UNION ALL SELECT document_id, section_id, 'parent_section_missing' FROM s WHERE p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s q WHERE q.document_id = s.document_id AND q.section_id = s.p)
UNION ALL SELECT document_id, block_id, 'block_document_missing' FROM b WHERE document_id NOT IN (SELECT document_id FROM d)
UNION ALL SELECT document_id, block_id, 'text_missing' FROM b WHERE text IS NULL UNION ALL SELECT document_id, block_id, 'page_missing' FROM b WHERE page IS NULL UNION ALL SELECT document_id, block_id, 'page_not_positive' FROM b WHERE page < 1
UNION ALL SELECT document_id, block_id, 'table_without_id' FROM b WHERE block_type = 'table' AND table_id IS NULL
UNION ALL SELECT document_id, concat_ws('/', page, reading_order), 'reading_order_repeated' FROM b GROUP BY document_id, page, reading_order HAVING count(*) > 1""",
    "chunk_checks": f"WITH {_CHECKS} SELECT * FROM issues",
    "issue_rollup": f"""WITH {_CHECKS}, g AS (SELECT document_id, count(*) AS issues, count(*) FILTER (rule IN ('no_text', 'index_not_contiguous')) AS errors FROM issues GROUP BY 1)
SELECT document_id, coalesce(g.issues, 0) AS issues, CASE WHEN errors > 0 THEN 'failed' WHEN g.issues > 0 THEN 'needs_revision' ELSE 'success' END AS status FROM (SELECT DISTINCT document_id FROM normalized_documents) LEFT JOIN g USING (document_id)""",
}
