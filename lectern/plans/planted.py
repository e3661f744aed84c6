"""Operators on small planted tables, for cases that the test tables do not hold.

Each table is stated once, as rows; Spark and SQL both start from these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import auditing as A
from lectern.operators import collection as C
from lectern.operators import matching as M
from lectern.operators import normalizing as N
from lectern.operators.cleaning import echoes
from lectern.operators.structure import duplicate_chunks
from lectern.plans.texts import _claims, _fold, _key, _normal, _numbers

_LONG = "Le patient reçoit le traitement pendant neuf semaines"

TABLES = {
    "chunk_rows": (
        "document_id string, chunk_id string, chunk_index int, text string",
        [("d", "a", 0, "Zweimal  derselbe\nText."), ("d", "b", 1, "Ein anderer."), ("d", "c", 2, "Zweimal derselbe Text."), ("d", "e", 3, ""), ("d", "f", 4, " "), ("d", "g", 5, "Zweimal derselbe Text."), ("e", "h", 0, "Zweimal derselbe Text."), ("e", "i", 1, None), ("d", "j", 6, "Été"), ("d", "k", 7, "Été")],
    ),
    "held": (
        "document_id string, chunk_id string, object_id string",
        [("d", "a", "r1"), ("d", "a", "r2"), ("d", "c", "r2"), ("d", "c", "r3"), ("d", "g", "r3"), ("d", "g", "r4"), ("d", "k", "r9"), ("e", "h", "r1"), ("x", "z", "r1")],
    ),
    "documents_known": ("document_id string, source_relative_path string", [("d", "a.pdf"), ("f", "b.pdf")]),
    "objects_known": ("document_id string, object_id string", [("d", "r1"), ("d", "r2"), ("d", "r3")]),
    "raw_rows": ("document_id string, page int, raw_block_id string, text string", [("d", 1, "r1", "steht in Blöcken"), ("d", 2, "r2", "ging verloren"), ("d", 2, "r3", " "), ("d", 3, "r4", "nur leere Blöcke"), ("e", 1, "r5", "kein Dokument")]),
    "block_rows": (
        "document_id string, page int, at int, block_id string, text string",
        [
            ("d", 1, 0, "b1", "Titel"), ("d", 1, 1, "b2", "dose | jours | malade | retour"), ("d", 1, 2, "b3", "Retour malade dose jours"), ("d", 1, 3, "b4", "dose dose jours malade"), ("d", 1, 4, "b5", "autre | table | avec | mots"), ("d", 1, 5, "b6", "dose jours malade retour"), ("d", 1, 6, "b7", "mots avec table autre"), ("d", 1, 7, "b8", "avec"),
            ("d", 3, 0, "b9", "erste | zeile | hat | vier"), ("d", 3, 1, "c1", "vier hat zeile erste"), ("d", 3, 2, "c2", None),
        ],
    ),
    "rewritten": ("id string, text string", [("t1", "La dose de 5 mg est probablement une Coquille Probable du texte."), ("t2", "Ce mot semble être une erreur, likely a typo."), ("t3", "Rien à signaler."), ("t4", None)]),
    "questions": (
        "question_id string, stem string, claim string, chunk_ids array<string>, evidence_chunk string, quotation string, review string, difficulty string",
        [
            ("q1", "Combien de semaines dure le traitement du patient ?", _LONG, ["k1"], "k1", _LONG, "unreviewed", "easy"), ("q2", "Combien  de semaines dure le traitement du PATIENT ?", _LONG, ["k1"], "k1", _LONG, "accepted", "easy"), ("q3", "Combien de semaines dure le traitement du patient âgé ?", "Il dure 12 jours selon l'image", ["k2", "gone"], "k2", "absent", "unreviewed", "hard"),
            ("q4", "Quelle dose, likely a typo, faut-il ?", _LONG, ["k3"], "k3", _LONG, "unreviewed", "medium"), ("q5", None, None, ["k4"], None, None, None, "medium"),
        ],
    ),
    "cited": ("chunk_id string, text string, eligible boolean", [("k1", f"{_LONG}.", True), ("k2", "Tout autre chose.", True), ("k3", f"{_LONG}.", False), ("k4", None, True)]),
    "chosen": ("chunk_id string", [("k1",), ("k2",), ("k3",)]),
    "wanted": ("difficulty string, wanted int", [("easy", 2), ("medium", 1), ("hard", 2)]),
    "items": (
        "document_id string, place int, label string, text string, document_type string, prov array<struct<page: int, top: double>>, captions array<string>, cells array<struct<row: int, col: int, text: string>>, n_rows int, n_cols int",
        [
            ("d", 0, "title", "Kopf", "pdf", [(1, 40.0)], None, None, None, None), ("d", 1, "watermark", "x", "pdf", [(1, 50.0)], None, None, None, None), ("d", 2, "section_header", "Eins", "pdf", [(1, 60.0), (2, 10.0)], [], None, None, None),
            ("d", 3, "table", None, "pdf", [(2, 80.0)], ["Tafel 1", "mehr"], [(0, 0, "A"), (0, 1, "B"), (1, 1, "2"), (1, 1, "zwei"), (7, 0, "fort")], 2, 2), ("d", 4, "chart", None, "pdf", [], [""], None, None, None), ("w", 0, "text", "Wort", "word", [(3, 1.0)], None, None, None, None), ("w", 1, "table", None, "word", None, None, None, 0, 0),
        ],
    ),
}


def _planted(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool | int | float):
        return str(v)
    if isinstance(v, list):
        return "[" + ", ".join(_literal(x) for x in v) + "]"
    return "'" + v.replace("'", "''") + "'"


def _values(name: str, columns: list[str] | None = None) -> str:
    """The planted table as a common table expression, of the named columns."""
    schema, rows = TABLES[name]
    names = [part.split()[0] for part in schema.split(", ") if part.split()[0][0].isalpha() and not part.split()[0].endswith(":")]
    kept = [i for i, n in enumerate(names) if columns is None or n in columns]
    body = ", ".join("(" + ", ".join(_literal(r[i]) for i in kept) + ")" for r in rows)
    return f"{name} AS (SELECT * FROM (VALUES {body}) AS v({', '.join(f'"{names[i]}"' for i in kept)}))"


def planted_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return duplicate_chunks(_planted(spark, "chunk_rows"))


def planted_retained(spark: SparkSession, folder: str) -> DataFrame:
    c = _planted(spark, "chunk_rows")
    return C.retained(c, duplicate_chunks(c)).select("document_id", "chunk_id", "position")


def planted_inherited(spark: SparkSession, folder: str) -> DataFrame:
    return C.inherited(duplicate_chunks(_planted(spark, "chunk_rows")), _planted(spark, "held"), "object_id")


def planted_dataset_issues(spark: SparkSession, folder: str) -> DataFrame:
    c = _planted(spark, "chunk_rows").withColumn("source_relative_path", F.when(F.col("chunk_id") != "b", "a.pdf"))
    return C.dataset_issues(c, _planted(spark, "documents_known"), _planted(spark, "held"), _planted(spark, "objects_known"))


def planted_fallback(spark: SparkSession, folder: str) -> DataFrame:
    blocks = _planted(spark, "block_rows").select("document_id", "page", F.when(F.col("page") == 1, F.col("text")).otherwise(" ").alias("text"))
    return M.pages_without_text(_planted(spark, "raw_rows"), blocks).select("document_id", "page", "raw_block_id")


def planted_echoes(spark: SparkSession, folder: str) -> DataFrame:
    return echoes(_planted(spark, "block_rows"))


def planted_corrections(spark: SparkSession, folder: str) -> DataFrame:
    return _planted(spark, "rewritten").select("id", F.explode(A.corrections(F.coalesce("text", F.lit("")))).alias("phrase"))


def planted_questions(spark: SparkSession, folder: str) -> DataFrame:
    return A.question_issues(_planted(spark, "questions"), _planted(spark, "cited"), _planted(spark, "chosen"))


def planted_difficulties(spark: SparkSession, folder: str) -> DataFrame:
    return A.distribution_issues(_planted(spark, "questions"), _planted(spark, "wanted"))


def planted_accepted(spark: SparkSession, folder: str) -> DataFrame:
    q = _planted(spark, "questions").select("question_id", "review")
    return A.accepted(q, q.filter("question_id <> 'q1'"), status="review").select("question_id")


def planted_items(spark: SparkSession, folder: str) -> DataFrame:
    return N.item_rows(_planted(spark, "items"))


QUERIES = {f.__name__: f for f in (planted_duplicates, planted_retained, planted_inherited, planted_dataset_issues, planted_fallback, planted_echoes, planted_corrections, planted_questions, planted_difficulties, planted_accepted, planted_items)}

_PAIRS = f"""{_values("chunk_rows")}, dup AS (SELECT * FROM (SELECT document_id, chunk_id, first_value(chunk_id) OVER (PARTITION BY document_id, t ORDER BY chunk_index, chunk_id) AS canonical_id FROM (SELECT *, {_normal("coalesce(text, '')")} AS t FROM chunk_rows) WHERE t <> '') WHERE chunk_id <> canonical_id)"""
_PHRASES = ", ".join(f"'{p}'" for p in A.CORRECTIONS)
_Q = f"""{_values("questions")}, {_values("cited")}, {_values("chosen")}, ci AS (SELECT DISTINCT question_id, unnest(chunk_ids) AS chunk_id FROM questions),
e AS (SELECT q.*, c.text AS evidence, {_claims("coalesce(claim, '')")} AS cw, {_claims("coalesce(quotation, '')")} AS qw, {_numbers("coalesce(claim, '')")} AS cn, {_numbers("coalesce(quotation, '')")} AS qn FROM questions q LEFT JOIN cited c ON c.chunk_id = q.evidence_chunk),
st AS (SELECT question_id, {_key("coalesce(stem, '')")} AS k FROM questions), fi AS (SELECT k, min(question_id) AS first FROM st GROUP BY 1), hd AS (SELECT first AS question_id, list_sort({_claims("k")}) AS ws FROM fi),
mt AS (SELECT ci.*, cited.chunk_id IS NOT NULL AS there, cited.eligible, ch.chunk_id IS NOT NULL AS chosen FROM ci LEFT JOIN cited USING (chunk_id) LEFT JOIN chosen ch USING (chunk_id))"""

SQL = {
    "planted_duplicates": f"WITH {_PAIRS} SELECT * FROM dup",
    "planted_retained": f"WITH {_PAIRS} SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) - 1 AS position FROM chunk_rows WHERE (document_id, chunk_id) NOT IN (SELECT (document_id, chunk_id) FROM dup)",
    "planted_inherited": f"WITH {_PAIRS}, {_values('held')}, g AS (SELECT DISTINCT h.document_id, canonical_id AS chunk_id, object_id FROM held h JOIN dup USING (document_id, chunk_id)) SELECT * FROM g EXCEPT SELECT * FROM held",
    "planted_dataset_issues": f"""WITH {_values("chunk_rows")}, {_values("held")}, {_values("documents_known")}, {_values("objects_known")} SELECT document_id, chunk_id AS item, 'chunk_of_unknown_document' AS rule FROM chunk_rows WHERE document_id NOT IN (SELECT document_id FROM documents_known)
UNION ALL SELECT document_id, '', 'document_without_chunks' FROM documents_known WHERE document_id NOT IN (SELECT document_id FROM chunk_rows) UNION ALL SELECT document_id, chunk_id, 'source_path_missing' FROM chunk_rows WHERE document_id = 'd' AND chunk_id = 'b'
UNION ALL SELECT DISTINCT document_id, chunk_id || '/' || object_id, 'object_unknown' FROM held WHERE (document_id, object_id) NOT IN (SELECT (document_id, object_id) FROM objects_known)""",
    "planted_fallback": f"WITH {_values('raw_rows')}, {_values('block_rows')} SELECT document_id, page, raw_block_id FROM raw_rows r WHERE trim(text) <> '' AND NOT EXISTS (SELECT 1 FROM block_rows b WHERE b.document_id = r.document_id AND b.page = r.page AND b.page = 1 AND trim(b.text) <> '')",
    "planted_echoes": f"""WITH {_values("block_rows")}, x AS (SELECT *, contains(text, '|') AS bar, regexp_extract_all({_fold("coalesce(text, '')")}, '[\\p{{L}}\\p{{N}}]+') AS w FROM block_rows)
SELECT c.document_id, c.block_id, t.block_id AS table_block_id FROM x c JOIN x t ON t.document_id = c.document_id AND t.page = c.page AND t.bar AND t.at > 0 AND c.at > t.at AND c.at - t.at <= 8 AND NOT coalesce(c.bar, false) AND len(c.w) >= 4 AND len(t.w) >= 4
WHERE NOT EXISTS (SELECT 1 FROM x z WHERE z.document_id = c.document_id AND z.page = c.page AND z.bar AND z.at > t.at AND z.at < c.at) AND len(list_filter(list_distinct(c.w), lambda y: len(list_filter(c.w, lambda z: z = y)) > len(list_filter(t.w, lambda z: z = y)))) = 0""",
    "planted_corrections": f"WITH {_values('rewritten')} SELECT id, phrase FROM (SELECT id, lower(nfc_normalize(text)) AS t, unnest([{_PHRASES}]) AS phrase FROM rewritten) WHERE contains(t, phrase)",
    "planted_questions": f"""WITH {_Q} SELECT question_id, 'nonexistent_chunk_reference' AS code FROM mt WHERE NOT there UNION ALL SELECT question_id, 'excluded_chunk_used' FROM mt WHERE there AND NOT eligible UNION ALL SELECT question_id, 'unselected_chunk_used' FROM mt WHERE there AND NOT chosen
UNION ALL SELECT question_id, 'invalid_initial_review_state' FROM e WHERE review IS DISTINCT FROM 'unreviewed' UNION ALL SELECT question_id, 'invalid_evidence_chunk' FROM e WHERE NOT coalesce(list_contains(chunk_ids, evidence_chunk), false) OR evidence IS NULL OR len(list_distinct(chunk_ids)) <> 1
UNION ALL SELECT question_id, 'evidence_quotation_mismatch' FROM e WHERE evidence IS NOT NULL AND NOT contains(evidence, coalesce(nullif(quotation, ''), chr(0))) UNION ALL SELECT question_id, 'unsupported_numeric_claim' FROM e WHERE len(list_filter(cn, lambda x: NOT list_contains(qn, x))) > 0
UNION ALL SELECT question_id, 'source_correction_language' FROM e WHERE len(list_filter([{_PHRASES}], lambda p: contains(lower(concat_ws(' ', stem, claim)), p))) > 0 UNION ALL SELECT question_id, 'low_lexical_support' FROM e WHERE len(cw) = 0 OR len(list_intersect(cw, qw)) / len(cw) < 0.35
UNION ALL SELECT question_id, 'duplicate_question' FROM st JOIN fi USING (k) WHERE question_id <> first UNION ALL SELECT DISTINCT b.question_id, 'near_duplicate_question' FROM hd a JOIN hd b ON a.question_id < b.question_id AND len(a.ws) > 0 AND len(b.ws) > 0 AND len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) >= 0.85""",
    "planted_difficulties": f"WITH {_values('questions')}, {_values('wanted')}, f AS (SELECT difficulty, count(*) AS n FROM questions GROUP BY 1) SELECT coalesce(f.difficulty, w.difficulty) AS difficulty, CAST(coalesce(wanted, 0) AS BIGINT) AS wanted, coalesce(n, 0) AS found FROM f FULL JOIN wanted w ON w.difficulty = f.difficulty WHERE coalesce(wanted, 0) <> coalesce(n, 0)",
    "planted_accepted": f"WITH {_values('questions')} SELECT question_id FROM questions WHERE review = 'accepted' UNION ALL SELECT question_id FROM questions WHERE review = 'accepted' AND question_id <> 'q1'",
    "planted_items": f"""WITH {_values("items", ["document_id", "place", "label", "text", "document_type"])}, t AS (SELECT *, CASE label WHEN 'section_header' THEN 'heading' WHEN 'text' THEN 'paragraph' WHEN 'chart' THEN 'figure' ELSE label END AS block_type FROM items WHERE label <> 'watermark'), n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY place) AS ordinal FROM t)
SELECT document_id, 'block-' || lpad(CAST(ordinal AS VARCHAR), 6, '0') AS block_id, block_type, ordinal, CASE place WHEN 0 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 END + CASE WHEN document_id = 'w' THEN NULL ELSE 0 END AS page, CAST(CASE WHEN document_id = 'd' THEN CASE place WHEN 0 THEN 40 WHEN 2 THEN 60 WHEN 3 THEN 80 END END AS DOUBLE) AS top, CASE WHEN document_id = 'd' AND place = 3 THEN 'Tafel 1' END AS caption, CASE WHEN block_type = 'table' THEN CASE document_id WHEN 'd' THEN 'A | B' || chr(10) || ' | zwei' ELSE '' END ELSE text END AS text FROM n""",
}
