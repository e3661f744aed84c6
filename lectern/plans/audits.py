"""Queries that hold texts against each other: raw and structured, original and rewritten, chunks and their references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import matching as M
from lectern.operators import structure as S
from lectern.operators.auditing import CORRECTIONS, corrections
from lectern.operators.ordering import neighbours, number
from lectern.operators.quality import fragment_follows
from lectern.plans.structures import _B, _O, _blocks, _chunks
from lectern.plans.texts import _SPACE, _signed, _units, _words
from lectern.session import cut_lineage
from lectern.sources.tables import latest_texts, table

def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "raw_blocks").select("document_id", "raw_block_id", F.col("location_number").alias("page"), "block_ordinal", "text").distinct()


def raw_fallback(spark: SparkSession, folder: str) -> DataFrame:
    return M.pages_without_text(_raw(spark, folder), _blocks(spark, folder, "page", "text")).select("document_id", "page", "raw_block_id")


def raw_matches(spark: SparkSession, folder: str) -> DataFrame:
    return M.match_raw(_blocks(spark, folder, "page", "text"), _raw(spark, folder))


def ocr_eligibility(spark: SparkSession, folder: str) -> DataFrame:
    p = _blocks(spark, folder, "page", "text", "asset_id").filter("page is not null").groupBy("document_id", "page").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n"), F.count("asset_id").alias("images"))
    g = p.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if((F.col("n") < 100) & (F.col("images") > 0)).alias("low"))
    share = F.try_divide(F.col("low").cast("double"), F.col("pages").cast("double"))
    return g.select("document_id", "pages", "low", F.when(share >= 0.5, "required").when(share > 0, "recommended").otherwise("not_needed").alias("decision"))


def broken_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Pages on which neighbouring blocks break off and go on, and how often."""
    value = X.strip(F.regexp_replace("text", rf"{X.SPACE}+", " "))
    b = _blocks(spark, folder, "page", "reading_order", value.alias("value")).filter("value <> ''")
    n = cut_lineage(number(b.select("document_id", "page", "reading_order", "block_id", F.left("value", F.lit(25)).alias("head"), F.right("value", F.lit(1)).alias("tail")), ["document_id"], ["page"], ["reading_order", "block_id"]))
    nxt = neighbours(n, ["document_id"], "ordinal", {"next_head": ("head", 1), "next_page": ("page", 1)})
    broken = fragment_follows(F.concat("head", "tail"), F.col("next_head")) & (F.length("head") >= 25) & F.col("next_page").eqNullSafe(F.col("page"))
    return nxt.groupBy("document_id", "page").agg(F.count_if(broken).alias("fragments")).filter("fragments > 0")


def correction_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Phrases of correction in rewritten texts."""
    keys = ["document_id", "transformation_id"]
    t = latest_texts(table(spark, folder, "model_transformations").select(*keys, "reconstructed_text", "ingested_at"), keys, "ingested_at")
    return t.select(*keys, F.explode(corrections(F.coalesce("reconstructed_text", F.lit("")))).alias("phrase"))


def evidence_order(spark: SparkSession, folder: str) -> DataFrame:
    refs = _chunks(spark, folder, "refs").select("document_id", "chunk_id", F.posexplode("refs").alias("at", "r")).select("document_id", "chunk_id", "at", F.col("r.block_id").alias("block_id"))
    return M.reference_order(refs, S.reading_order(_blocks(spark, folder, "page", "reading_order")))


def unique_references(spark: SparkSession, folder: str) -> DataFrame:
    c = _chunks(spark, folder, "refs")
    return c.select("document_id", "chunk_id", F.coalesce(F.size("refs"), F.lit(0)).cast("bigint").alias("references"), F.coalesce(F.size(F.array_distinct("refs")), F.lit(0)).cast("bigint").alias("distinct_references"))


def ordered_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of a document in the order in which blocks first name them."""
    o = S.reading_order(_blocks(spark, folder, "page", "reading_order", "section_id"))
    first = o.filter("section_id is not null").groupBy("document_id", "section_id").agg(F.min("ordinal").alias("first_ordinal"))
    stretch = first.withColumn("stretch", F.floor(F.col("first_ordinal") / 1000))
    return number(stretch, ["document_id"], ["stretch"], ["first_ordinal"], "place").drop("stretch")


#: Codes of what a rewriting added, lost or changed.
AUDIT_CODES = ["unsupported_numerical_token", "unsupported_unit", "unsupported_lexical_addition", "informative_source_tokens_missing", "changed_negation", "changed_modal_word", "missing_transformation_support_basis"]


def audit_issues(spark: SparkSession, folder: str) -> DataFrame:
    """``document_id, transformation_id, code, n``: what a rewriting added, lost or changed, and how many values that concerns.

    All bags of a pair (numbers, units, words to either side) are compared in
    one aggregation of signed counts.
    """
    keys = ["document_id", "transformation_id"]
    t = latest_texts(table(spark, folder, "model_transformations").select(*keys, "original_text", "reconstructed_text", "support_basis", "ingested_at"), keys, "ingested_at", [*keys, "original_text", "reconstructed_text", "support_basis"])
    o, r = F.coalesce("original_text", F.lit("")), F.coalesce("reconstructed_text", F.lit(""))
    t = t.select(*keys, F.coalesce(F.trim("support_basis"), F.lit("")).alias("basis"), X.words(o).alias("ow"), X.words(r).alias("rw"), X.signed_numbers(o).alias("on"), X.signed_numbers(r).alias("rn"), X.units(o).alias("ou"), X.units(r).alias("ru"))
    listed = lambda words: F.array(*[F.lit(w) for w in words])
    worth = lambda c, n: F.filter(c, lambda w: (F.length(w) >= n) & ~w.rlike(r"^\p{Nd}+$"))
    own = lambda c: F.filter(worth(c, 4), lambda w: ~F.array_contains(listed(X.PRESENTATION_WORDS), w))
    bags = dict(zip(AUDIT_CODES, ((F.col("rn"), F.col("on")), (F.col("ru"), F.col("ou")), (own("rw"), own("ow")), (worth("ow", 3), worth("rw", 3)))))
    signed = lambda code, a, n: F.transform(a, lambda v: F.struct(F.lit(code).alias("code"), v.alias("v"), F.lit(n).alias("n")))
    each = t.select(*keys, F.explode(F.concat(*[signed(code, side, n) for code, sides in bags.items() for side, n in zip(sides, (1, -1))])).alias("x"))
    extra = each.groupBy(*keys, "x.code", "x.v").agg(F.sum("x.n").alias("n")).filter("n > 0").groupBy(*keys, "code").agg(F.sum("n").alias("n"))
    differ = lambda words: F.array_sort(F.array_intersect(F.col("ow"), listed(words))) != F.array_sort(F.array_intersect(F.col("rw"), listed(words)))
    flags = {"changed_negation": differ(X.NEGATIONS), "changed_modal_word": differ(X.MODALS), "missing_transformation_support_basis": F.col("basis") == ""}
    flagged = t.select(*keys, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in flags.items()]))).alias("code"), F.lit(1).cast("bigint").alias("n"))
    return extra.unionByName(flagged)


QUERIES = {f.__name__: f for f in (raw_fallback, raw_matches, ocr_eligibility, broken_fragments, correction_phrases, evidence_order, unique_references, ordered_sections, audit_issues)}

_RAW = "r AS (SELECT DISTINCT document_id, raw_block_id, location_number AS page, block_ordinal, text FROM raw_blocks)"
_CHUNKS = "c AS (SELECT document_id, chunk_id, arg_max(refs, generated_at) AS refs FROM chunks GROUP BY 1, 2)"


_T = "p AS (SELECT document_id, transformation_id, coalesce(x.o, '') AS o, coalesce(x.r, '') AS r, coalesce(trim(x.b, ' '), '') AS b FROM (SELECT document_id, transformation_id, arg_max(struct_pack(o := original_text, r := reconstructed_text, b := support_basis), ingested_at) AS x FROM model_transformations GROUP BY 1, 2))"


def _lost(a: str, b: str, code: str) -> str:
    return f"""SELECT document_id, transformation_id, CAST(sum(greatest(n - coalesce(m, 0), 0)) AS BIGINT) AS n, '{code}' AS code FROM (SELECT document_id, transformation_id, v, count(*) AS n FROM (SELECT document_id, transformation_id, unnest({a}) AS v FROM p) GROUP BY ALL)
LEFT JOIN (SELECT document_id, transformation_id, v, count(*) AS m FROM (SELECT document_id, transformation_id, unnest({b}) AS v FROM p) GROUP BY ALL) USING (document_id, transformation_id, v) GROUP BY 1, 2 HAVING sum(greatest(n - coalesce(m, 0), 0)) > 0"""


def _worth(x: str, n: int, apart: list[str] | None = None) -> str:
    other = f" AND NOT list_contains([{', '.join(repr(w) for w in apart)}], w)" if apart else ""
    return f"list_filter({_words(x)}, lambda w: length(w) >= {n} AND NOT regexp_matches(w, '^\\p{{Nd}}+$'){other})"


def _changed(words: list[str], code: str) -> str:
    own = lambda x: f"list_sort(list_distinct(list_filter({_words(x)}, lambda w: list_contains([{', '.join(repr(w) for w in words)}], w))))"
    return f"SELECT document_id, transformation_id, 1::BIGINT AS n, '{code}' AS code FROM p WHERE {own('o')} <> {own('r')}"


SQL = {
    "raw_fallback": f"WITH {_B}, {_RAW} SELECT document_id, page, raw_block_id FROM r WHERE trim(coalesce(text, ''), ' ') <> '' AND NOT EXISTS (SELECT 1 FROM b WHERE b.document_id = r.document_id AND b.page = r.page AND trim(coalesce(b.text, ''), ' ') <> '')",
    "ocr_eligibility": f"""WITH {_B}, p AS (SELECT document_id, page, sum(length(coalesce(text, ''))) AS n, count(asset_id) AS images FROM b WHERE page IS NOT NULL GROUP BY 1, 2), g AS (SELECT document_id, count(*) AS pages, count(*) FILTER (n < 100 AND images > 0) AS low FROM p GROUP BY 1)
SELECT document_id, pages, low, CASE WHEN low / pages >= 0.5 THEN 'required' WHEN low > 0 THEN 'recommended' ELSE 'not_needed' END AS decision FROM g""",
    "broken_fragments": f"""WITH {_B}, v AS (SELECT document_id, page, reading_order, block_id, regexp_replace(regexp_replace(text, '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g') AS v FROM b), n AS (SELECT document_id, page, v, lead(v) OVER w AS nv, lead(page) OVER w AS np, lead(block_id) OVER w AS nb FROM v WHERE v <> '' WINDOW w AS (PARTITION BY document_id ORDER BY page NULLS FIRST, reading_order NULLS FIRST, block_id))
SELECT document_id, page, count(*) AS fragments FROM n WHERE nb IS NOT NULL AND page IS NOT DISTINCT FROM np AND length(v) >= 25 AND NOT regexp_matches(v, '^-|^===== TABLE') AND NOT regexp_matches(v, '[.:;?!)]$') AND regexp_matches(nv, '^\\p{{Ll}}') GROUP BY 1, 2""",
    "correction_phrases": f"WITH {_T} SELECT document_id, transformation_id, phrase FROM (SELECT document_id, transformation_id, lower(nfc_normalize(r)) AS t, unnest([" + ", ".join(f"'{p}'" for p in CORRECTIONS) + "]) AS phrase FROM p) WHERE contains(t, phrase)",
    "evidence_order": f"""WITH {_O}, {_CHUNKS}, e AS (SELECT document_id, chunk_id, unnest(refs) AS r, unnest(range(len(refs))) AS i FROM c), k AS (SELECT e.*, o.ordinal FROM e LEFT JOIN o ON o.document_id = e.document_id AND o.block_id = e.r.block_id),
s AS (SELECT *, lag(ordinal) OVER (PARTITION BY document_id, chunk_id ORDER BY i) AS before FROM k WHERE ordinal IS NOT NULL), t AS (SELECT document_id, chunk_id, count(*) FILTER (ordinal < before) AS reordered FROM s GROUP BY 1, 2)
SELECT k.document_id, k.chunk_id, count(*) AS "references", count(*) FILTER (ordinal IS NULL) AS unknown, coalesce(any_value(t.reordered), 0) AS reordered, coalesce(max(ordinal) - min(ordinal) + 1 - count(DISTINCT ordinal), 0) AS gaps FROM k LEFT JOIN t USING (document_id, chunk_id) GROUP BY 1, 2""",
    "unique_references": f'WITH {_CHUNKS} SELECT document_id, chunk_id, coalesce(len(refs), 0) AS "references", coalesce(len(list_distinct(refs)), 0) AS distinct_references FROM c',
    "ordered_sections": f"WITH {_O}, f AS (SELECT document_id, section_id, min(ordinal) AS first_ordinal FROM o WHERE section_id IS NOT NULL GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY first_ordinal) AS place FROM f",
    "audit_issues": f"WITH {_T} {_lost(_signed('r'), _signed('o'), 'unsupported_numerical_token')} UNION ALL {_lost(_units('r'), _units('o'), 'unsupported_unit')} UNION ALL {_lost(_worth('r', 4, X.PRESENTATION_WORDS), _worth('o', 4, X.PRESENTATION_WORDS), 'unsupported_lexical_addition')} UNION ALL {_lost(_worth('o', 3), _worth('r', 3), 'informative_source_tokens_missing')} UNION ALL {_changed(X.NEGATIONS, 'changed_negation')} UNION ALL {_changed(X.MODALS, 'changed_modal_word')} UNION ALL SELECT document_id, transformation_id, 1::BIGINT, 'missing_transformation_support_basis' FROM p WHERE b = ''",
}
