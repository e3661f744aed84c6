"""Queries on scalar text functions: normal forms, tokens, ratios, audits of rewritten texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.labels import language_code, source_of
from lectern.operators.cleaning import clean_pages, clean_texts
from lectern.operators.multisets import difference
from lectern.sources.tables import latest, latest_texts, table


def blocks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The latest delivery of every block."""
    keys = ["document_id", "block_id"]
    return latest_texts(table(spark, folder, "blocks").select(*keys, *columns, "ingested_at"), keys, "ingested_at", [*keys, *columns])


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["document_id", "transformation_id"]
    return latest_texts(table(spark, folder, "model_transformations"), keys, "ingested_at", [*keys, "original_text", "reconstructed_text"])


def normalize_text_hash(spark: SparkSession, folder: str) -> DataFrame:
    t = blocks(spark, folder, "text").filter("text is not null")
    return t.select("document_id", "block_id", X.text_hash(F.col("text")).alias("text_hash"), F.length(X.normalize_text(F.col("text"))).cast("bigint").alias("characters"))


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


def token_stats(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("source", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("characters"), F.sum(X.token_estimate(F.col("n"))).cast("bigint").alias("tokens"), F.min("n").cast("bigint").alias("least"), F.max("n").cast("bigint").alias("most"))


def key_texts(spark: SparkSession, folder: str) -> DataFrame:
    b = blocks(spark, folder, "block_type", "text").filter("block_type in ('header', 'footer', 'title', 'heading') and text is not null")
    return b.groupBy(X.key_text(F.col("text")).alias("key_text")).agg(F.count(F.lit(1)).alias("blocks"), F.countDistinct("document_id").alias("documents"))


def cleaned_blocks(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "raw_blocks").select("document_id", "raw_block_id", "text").distinct()
    return r.select("document_id", "raw_block_id", X.clean_block(F.col("text")).alias("cleaned"))


def _cleaning(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "raw_blocks").select("document_id", F.col("raw_block_id").alias("block_id"), F.col("location_number").alias("page"), F.col("block_ordinal").alias("place"), "text").distinct()
    return clean_pages(raw)


def cleaning_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of every raw block and why."""
    return _cleaning(spark, folder).select("document_id", "block_id", "page", "ordinal", F.sha2("text", 256).alias("text_hash"), "classification", "retained", "reason")


def cleaned_texts(spark: SparkSession, folder: str) -> DataFrame:
    return clean_texts(_cleaning(spark, folder)).select("document_id", F.length("text").cast("bigint").alias("characters"), F.sha2("text", 256).alias("sha256"))


def language_script(spark: SparkSession, folder: str) -> DataFrame:
    b = blocks(spark, folder, "text").filter("text is not null")
    return b.groupBy(X.script(F.col("text")).alias("script")).agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).alias("characters"))


def language_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").groupBy(language_code(F.col("lang")).alias("language")).agg(F.count(F.lit(1)).alias("documents"), F.countDistinct(F.coalesce("lang", F.lit(""))).alias("labels"))


def source_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").groupBy(source_of(F.col("source_relative_path")).alias("source")).agg(F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("source_relative_path").alias("spellings"))


def text_ratios(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "raw_blocks").select("document_id", "raw_block_id", "text").distinct()
    ratio = lambda c, n: F.round(c, 6).alias(n)
    t = F.col("text")
    return r.select("document_id", "raw_block_id", ratio(X.alpha_ratio(t), "alpha"), ratio(X.single_letter_ratio(t), "single"), ratio(X.symbol_ratio(t), "symbols"))


def heading_lines(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return d.filter(X.is_heading(F.col("line"))).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


def number_tokens(spark: SparkSession, folder: str) -> DataFrame:
    p = pairs(spark, folder)
    return p.select("document_id", "transformation_id", F.size(X.numbers(F.coalesce("original_text", F.lit("")))).cast("bigint").alias("original_numbers"), F.size(X.numbers(F.coalesce("reconstructed_text", F.lit("")))).cast("bigint").alias("new_numbers"), F.array_join(X.measured(F.coalesce("reconstructed_text", F.lit(""))), ";").alias("measured"))


def number_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return pairs(spark, folder).select("document_id", "transformation_id", X.number_pattern(F.coalesce("original_text", F.lit(""))).alias("pattern"))


def unsupported_numbers(spark: SparkSession, folder: str) -> DataFrame:
    p = pairs(spark, folder)
    return difference(p, ["document_id", "transformation_id"], X.numbers(F.coalesce("reconstructed_text", F.lit(""))), X.numbers(F.coalesce("original_text", F.lit(""))), "number")


def missing_words(spark: SparkSession, folder: str) -> DataFrame:
    p = pairs(spark, folder)
    long = lambda c: F.filter(X.words(F.coalesce(c, F.lit(""))), lambda w: F.length(w) >= 3)
    return difference(p, ["document_id", "transformation_id"], long("original_text"), long("reconstructed_text"), "word")


def changed_modality(spark: SparkSession, folder: str) -> DataFrame:
    listed = F.array(*[F.lit(w) for w in [*X.NEGATIONS, *X.MODALS]])
    own = lambda c: F.array_join(F.array_sort(F.array_intersect(X.words(F.coalesce(c, F.lit(""))), listed)), " ")
    p = pairs(spark, folder).select("document_id", "transformation_id", own("original_text").alias("before"), own("reconstructed_text").alias("after"))
    return p.filter("before <> after")


def lexical_support(spark: SparkSession, folder: str) -> DataFrame:
    a, b = X.claim_words(F.coalesce("reconstructed_text", F.lit(""))), X.claim_words(F.coalesce("original_text", F.lit("")))
    return pairs(spark, folder).select("document_id", "transformation_id", F.round(X.contained(a, b), 6).alias("support"), F.round(X.jaccard(a, b), 6).alias("similarity"))


def identity_keys(spark: SparkSession, folder: str) -> DataFrame:
    d = latest(table(spark, folder, "normalized_documents"), ["document_id"], "ingested_at", ["document_id", "source_relative_path", "title", "page_or_slide_count"])
    return d.select("document_id", X.identity(F.col("source_relative_path"), F.col("title"), F.col("page_or_slide_count")).alias("identity"))


def common_folders(spark: SparkSession, folder: str) -> DataFrame:
    """The folders that all files of a source share: those that the least and the greatest folder share."""
    d = latest(table(spark, folder, "normalized_documents"), ["document_id"], "ingested_at", ["document_id", "source_relative_path"])
    parts = F.split(F.regexp_replace("source_relative_path", "/[^/]*$", ""), "/").alias("parts")
    each = d.select(F.split("source_relative_path", "/")[0].alias("source"), parts).groupBy("source").agg(F.min("parts").alias("lo"), F.max("parts").alias("hi"), F.countDistinct("parts").alias("folders"))
    return each.select("source", X.shared_folders(F.col("lo"), F.col("hi")).alias("common"), "folders")


QUERIES = {
    f.__name__: f
    for f in (
        normalize_text_hash, file_hashes, token_stats, key_texts, cleaned_blocks, cleaning_decisions, cleaned_texts, language_script, language_labels, source_names, text_ratios, heading_lines, number_tokens, number_patterns, unsupported_numbers, missing_words,
        changed_modality, lexical_support, identity_keys, common_folders,
    )
}

_B = "(SELECT document_id, block_id, arg_max(struct_pack(text := text, block_type := block_type), ingested_at) AS b FROM blocks GROUP BY 1, 2)"
_P = "(SELECT document_id, transformation_id, coalesce(p.o, '') AS o, coalesce(p.r, '') AS r FROM (SELECT document_id, transformation_id, arg_max(struct_pack(o := original_text, r := reconstructed_text), ingested_at) AS p FROM model_transformations GROUP BY 1, 2))"
_D = "(SELECT document_id, d.* FROM (SELECT document_id, arg_max(struct_pack(source_relative_path := source_relative_path, title := title, page_or_slide_count := page_or_slide_count), ingested_at) AS d FROM normalized_documents GROUP BY 1))"
_R = "(SELECT DISTINCT document_id, raw_block_id, text FROM raw_blocks)"
_S = r"[\t\n\x0b\f\r ]"


#: White space of every kind, and any character that is no letter, digit or underscore, for DuckDB.
_SPACE = r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_OUT = r"[^\p{L}\p{N}_]"


def _fold(x: str) -> str:
    x = f"lower(nfc_normalize({x}))"
    for a, b in {"ß": "ss", "µ": "μ", "ς": "σ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}.items():
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _normal(x: str) -> str:
    lines = "array_to_string(list_filter(list_transform(string_split(p, chr(10)), lambda l: " + _strip("regexp_replace(l, '[ \\t]+', ' ', 'g')") + "), lambda l: l <> ''), ' ')"
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array(replace(replace(nfc_normalize({x}), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n{_SPACE}*\\n'), lambda p: {lines}), lambda p: p <> ''), chr(10) || chr(10))"


def _key(x: str) -> str:
    return f"trim(regexp_replace({_fold(x)}, '{_SPACE}+', ' ', 'g'), ' ')"


def _words(x: str) -> str:
    return f"regexp_extract_all({_fold(x)}, '([\\p{{L}}\\p{{N}}]+(?:[''’][\\p{{L}}\\p{{N}}]+)?)', 1)"


def _twice(x: str) -> str:
    """Every character between words doubled, since a match may eat one on either side."""
    return f"regexp_replace({x}, '({_OUT})', '\\1\\1', 'g')"


def _numbers(x: str) -> str:
    found = f"regexp_extract_all({_twice(x)}, '(?:^|{_OUT})(\\p{{Nd}}+(?:\\.\\.\\p{{Nd}}+|,,\\p{{Nd}}+)?)(?:{_OUT}|$)', 1)"
    return f"list_transform({found}, lambda y: replace(replace(y, '..', '.'), ',,', ','))"


def _signed(x: str) -> str:
    free = f"regexp_replace({x}, '([\\p{{L}}\\p{{N}}_])[<>≤≥±+\\-]', '\\1;', 'g')"
    found = f"regexp_extract_all({_twice(free)}, '(?:^|{_OUT})((?:<<|>>|≤≤|≥≥|±±|\\+\\+|--)?\\p{{Nd}}+(?:\\.\\.\\p{{Nd}}+|,,\\p{{Nd}}+)?(?:{_SPACE}*(?:%%|‰‰))?)(?:{_OUT}|$)', 1)"
    single = "y"
    for sign in "<>≤≥±+-.,%‰":
        single = f"replace({single}, '{sign}{sign}', '{sign}')"
    return f"list_transform({found}, lambda y: regexp_replace({single}, '{_SPACE}+', ' ', 'g'))"


def _units(x: str) -> str:
    listed = "|".join(sorted((u for u in X.UNITS if u != "%"), key=lambda u: (-len(u), u)))
    return f"list_transform(regexp_extract_all({_twice(x)}, '(?:^|{_OUT})((?i:{listed}))(?:{_OUT}|$)', 1), lambda y: lower(y))"


def _clean(x: str) -> str:
    t = f"regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), '[\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g')"
    t = f"regexp_replace({t}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"
    t = f"regexp_replace({t}, '([\\p{{L}}\\p{{N}}_])-{_SPACE}*\\n{_SPACE}*([a-zà-öø-ÿ])', '\\1\\2', 'g')"
    bullets = X.BULLETS.replace("\\s", _SPACE)
    single = "regexp_replace(l, '[ \\t\\x{a0}]+', ' ', 'g')"
    line = f"regexp_replace({_strip(single)}, '^(?:{bullets}){_SPACE}*', '- ')"
    lines = f"list_filter(list_transform(string_split({t}, chr(10)), lambda l: {line}), lambda l: l <> '')"
    rows = f"len(list_filter({lines}, lambda l: contains(l, '|') OR starts_with(l, '- '))) > 0"
    return _strip(f"CASE WHEN {rows} THEN array_to_string({lines}, chr(10)) ELSE array_to_string({lines}, ' ') END")


def _claims(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
    return f"list_filter(list_distinct(regexp_extract_all({_fold(x)}, '(\\p{{L}}{{3,}})', 1)), lambda w: NOT list_contains([{stop}], w))"


def _minus(a: str, b: str, name: str) -> str:
    return f"""WITH p AS {_P}, a AS (SELECT document_id, transformation_id, x, count(*) AS n FROM (SELECT document_id, transformation_id, unnest({a}) AS x FROM p) GROUP BY ALL),
b AS (SELECT document_id, transformation_id, x, count(*) AS n FROM (SELECT document_id, transformation_id, unnest({b}) AS x FROM p) GROUP BY ALL)
SELECT document_id, transformation_id, a.x AS {name}, a.n - coalesce(b.n, 0) AS surplus FROM a LEFT JOIN b USING (document_id, transformation_id, x) WHERE a.n > coalesce(b.n, 0)"""


_UNITS = "|".join(sorted(X.UNITS, key=lambda u: (-len(u), u)))
_MODAL = ", ".join(f"'{w}'" for w in [*X.NEGATIONS, *X.MODALS])
_LABELS = "CASE WHEN lang IS NULL OR trim(lang) IN ('', 'und') THEN 'und' ELSE coalesce(map {'fra': 'fr', 'french': 'fr', 'deu': 'de', 'ger': 'de', 'german': 'de', 'eng': 'en', 'english': 'en', 'spa': 'es', 'spanish': 'es'}[regexp_extract(lower(trim(lang)), '^(\\p{L}+)', 1)], regexp_extract(lower(trim(lang)), '^(\\p{L}+)', 1)) END"


def _own(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter({_words(x)}, lambda w: list_contains([{_MODAL}], w)))), ' ')"


_EDGE = "(?:^|[^\\p{L}\\p{N}_])"
_TEACHER = _EDGE + "(?:(?:pr(?:of(?:esseur)?)?\\.?|dr\\.?)[\\t\\n\\x0b\\f\\r ]+[a-zà-öø-þ]|auteur[\\t\\n\\x0b\\f\\r ]*:)"
_PLACE = _EDGE + "(?:facult[ée]|universit[ée]|h[oô]pital|chu(?:[^\\p{L}\\p{N}_]|$)|service[\\t\\n\\x0b\\f\\r ]+de|minist[eè]re|centre[\\t\\n\\x0b\\f\\r ]+r[ée]gional)"
_YEAR = _EDGE + "(?:19|20)\\p{Nd}{2}[\\t\\n\\x0b\\f\\r ]*[-–/][\\t\\n\\x0b\\f\\r ]*(?:19|20)?\\p{Nd}{2}(?:[^\\p{L}\\p{N}_]|$)"
_CLEANING = f"""WITH r AS (SELECT DISTINCT document_id, raw_block_id AS block_id, location_number AS page, block_ordinal AS place, coalesce(text, '') AS raw FROM raw_blocks),
c0 AS (SELECT *, {_clean("raw")} AS c FROM r),
c1 AS (SELECT *, {_strip("regexp_replace(c, '^(TITLE|CONTENT|NOTES):( |$)', ' ')")} AS bare FROM c0),
c AS (SELECT document_id, block_id, page, place, CASE WHEN regexp_matches(bare, '(?i)^(?:CamScanner|Scanned +with +CamScanner)$') THEN '' ELSE bare END AS text FROM c1),
o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page NULLS FIRST, place NULLS FIRST, block_id) AS ordinal, row_number() OVER (PARTITION BY document_id, page ORDER BY place NULLS FIRST, block_id) - 1 AS at, {_key("text")} AS k, contains(text, '|') AS bar, contains(text, '|') OR regexp_matches(text, '^===== TABLE [1-9][0-9]* =====$') AS stop, regexp_extract_all({_fold("text")}, '[\\p{{L}}\\p{{N}}]+') AS t FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY ordinal) AS n, count(*) OVER (PARTITION BY document_id, page) AS total FROM o WHERE text <> '' AND NOT regexp_matches(text, '^===== TABLE [1-9][0-9]* =====$')),
pg AS (SELECT document_id, count(DISTINCT page) AS pages FROM e GROUP BY 1),
sd AS (SELECT document_id, page, k, true AS head FROM e WHERE n <= 4 AND length(text) < 220 UNION ALL SELECT document_id, page, k, false FROM e WHERE n > total - 2 AND length(text) < 220),
bk AS (SELECT document_id, k, bool_or(head) AS head FROM (SELECT document_id, k, head FROM sd JOIN pg USING (document_id) GROUP BY document_id, k, head, pages HAVING count(DISTINCT page) >= greatest(2, (pages + 1) // 2)) GROUP BY 1, 2),
fi AS (SELECT o.document_id, o.k, head, min(ordinal) AS first FROM o JOIN bk ON bk.document_id = o.document_id AND bk.k = o.k WHERE o.text <> '' GROUP BY 1, 2, 3),
ec AS (SELECT DISTINCT c.document_id, c.block_id FROM o c JOIN o t ON t.document_id = c.document_id AND t.page IS NOT DISTINCT FROM c.page AND t.bar AND t.at > 0 AND c.at > t.at AND c.at - t.at <= 8 AND NOT c.stop AND len(c.t) >= 4 AND len(t.t) >= 4
  WHERE NOT EXISTS (SELECT 1 FROM o z WHERE z.document_id = c.document_id AND z.page IS NOT DISTINCT FROM c.page AND z.stop AND z.at > t.at AND z.at < c.at) AND len(list_filter(list_distinct(c.t), lambda y: len(list_filter(c.t, lambda z: z = y)) > len(list_filter(t.t, lambda z: z = y)))) = 0),
m AS (SELECT o.*, fi.head, o.text <> '' AND coalesce(o.ordinal > fi.first, false) AS again, ec.block_id IS NOT NULL AS echo FROM o LEFT JOIN fi ON fi.document_id = o.document_id AND fi.k = o.k LEFT JOIN ec ON ec.document_id = o.document_id AND ec.block_id = o.block_id),
l AS (SELECT *, last_value(CASE WHEN text <> '' AND NOT again AND NOT echo THEN k END IGNORE NULLS) OVER (PARTITION BY document_id, page ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lk FROM m),
done AS (SELECT document_id, block_id, page, ordinal, text, CASE WHEN again THEN CASE WHEN head THEN 'repeated_header' ELSE 'repeated_footer' END WHEN regexp_matches(lower(text), '{_TEACHER}') THEN 'teacher_name' WHEN regexp_matches(lower(text), '{_PLACE}') THEN 'institution' WHEN regexp_matches(text, '{_YEAR}') THEN 'academic_year'
  WHEN ordinal <= 18 AND length(trim(text, ' :-')) BETWEEN 3 AND 180 AND NOT regexp_matches(trim(text, ' :-'), '^-|[.;]$') AND len(regexp_extract_all(trim(text, ' :-'), '\\p{{L}}')) >= 3 THEN 'course_title' ELSE 'body_content' END AS classification,
  CASE WHEN again THEN CASE WHEN head THEN 'repeated header' ELSE 'repeated footer' END WHEN text <> '' AND lk = k THEN 'repeats the block before' WHEN echo THEN 'repeats a table' END AS reason FROM l)
"""

SQL = {
    "normalize_text_hash": f"SELECT document_id, block_id, sha256({_normal('b.text')}) AS text_hash, length({_normal('b.text')}) AS characters FROM {_B} WHERE b.text IS NOT NULL",
    "file_hashes": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "token_stats": "SELECT source, count(*) AS documents, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS characters, CAST(sum((length(coalesce(text, '')) + 3) // 4) AS BIGINT) AS tokens, min(length(coalesce(text, ''))) AS least, max(length(coalesce(text, ''))) AS most FROM documents GROUP BY 1",
    "key_texts": f"SELECT {_key('b.text')} AS key_text, count(*) AS blocks, count(DISTINCT document_id) AS documents FROM {_B} WHERE b.block_type IN ('header', 'footer', 'title', 'heading') AND b.text IS NOT NULL GROUP BY 1",
    "cleaned_blocks": f"SELECT document_id, raw_block_id, {_clean('text')} AS cleaned FROM {_R}",
    "cleaning_decisions": _CLEANING + "SELECT document_id, block_id, page, ordinal, sha256(text) AS text_hash, classification, reason IS NULL AS retained, reason FROM done",
    "cleaned_texts": _CLEANING
    + """, p AS (SELECT document_id, page, '[Page ' || page || ']' || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY ordinal) AS body FROM done WHERE reason IS NULL AND text <> '' GROUP BY 1, 2),
w AS (SELECT document_id, string_agg(body, chr(10) || chr(10) ORDER BY page) || chr(10) AS text FROM p GROUP BY 1) SELECT document_id, length(text) AS characters, sha256(text) AS sha256 FROM w""",
    "language_script": f"""SELECT CASE WHEN regexp_matches(b.text, '[؀-ۿ]') AND regexp_matches(b.text, '[A-Za-zÀ-ÿ]') THEN 'fr+ar' WHEN regexp_matches(b.text, '[؀-ۿ]') THEN 'ar' ELSE 'fr' END AS script,
count(*) AS blocks, CAST(sum(length(b.text)) AS BIGINT) AS characters FROM {_B} WHERE b.text IS NOT NULL GROUP BY 1""",
    "language_labels": f"SELECT {_LABELS} AS language, count(*) AS documents, count(DISTINCT coalesce(lang, '')) AS labels FROM documents GROUP BY 1",
    "source_names": r"SELECT regexp_extract(regexp_replace(regexp_replace(regexp_replace(trim(lower(url_decode(source_relative_path))), ' *[\\/]+ *', '/', 'g'), '^(\./)+', ''), '^/', ''), '^([^/]+)', 1) AS source, count(DISTINCT chunk_id) AS chunks, count(DISTINCT source_relative_path) AS spellings FROM chunks GROUP BY 1",
    "text_ratios": rf"""SELECT document_id, raw_block_id,
round(coalesce(len(regexp_extract_all(text, '\p{{L}}')) / nullif(len(regexp_extract_all(text, '[^\t\n\x0b\f\r ]')), 0), 0.0), 6) AS alpha,
round(coalesce(len(list_filter(regexp_extract_all(text, '\p{{L}}+'), lambda w: length(w) = 1)) / nullif(len(regexp_extract_all(text, '\p{{L}}+')), 0), 1.0), 6) AS single,
round(coalesce(len(list_filter(regexp_extract_all(text, '[\p{{S}}\p{{Cc}}]'), lambda x: NOT regexp_matches(x, '[\t\n\x0b\f\r ]'))) / nullif(len(regexp_extract_all(text, '[^\t\n\x0b\f\r ]')), 0), 0.0), 6) AS symbols FROM {_R}""",
    "heading_lines": r"""SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL)
WHERE length(line) BETWEEN 3 AND 120 AND NOT regexp_matches(line, '[.;,]$') AND len(regexp_extract_all(line, '\p{L}')) >= 3
AND (regexp_matches(line, '^[\t\n\x0b\f\r ]*(?:\p{Nd}+(?:\.\p{Nd}+)*[.)]?|[IVXLC]+[.)-]|[A-Z][.)])[\t\n\x0b\f\r ]+\p{L}') OR len(regexp_extract_all(line, '\p{Lu}')) / len(regexp_extract_all(line, '\p{L}')) >= 0.55)""",
    "number_tokens": f"""SELECT document_id, transformation_id, len({_numbers("o")}) AS original_numbers, len({_numbers("r")}) AS new_numbers,
array_to_string(list_transform(regexp_extract_all(r, '(\\p{{Nd}}+(?:[.,]\\p{{Nd}}+)?{_S}*(?i:{_UNITS}))(?:[^\\p{{L}}\\p{{N}}]|$)', 1), lambda x: regexp_replace(x, '^([\\p{{Nd}}.,]+){_S}*', '\\1 ')), ';') AS measured FROM {_P}""",
    "number_patterns": f"SELECT document_id, transformation_id, array_to_string(list_transform(list_sort(list_transform(list_distinct({_numbers('o')}), lambda x: struct_pack(n := -length(x), x := x))), lambda s: replace(s.x, '.', chr(92) || '.')), '|') AS pattern FROM {_P}",
    "unsupported_numbers": _minus(_numbers("r"), _numbers("o"), "number"),
    "missing_words": _minus(f"list_filter({_words('o')}, lambda w: length(w) >= 3)", f"list_filter({_words('r')}, lambda w: length(w) >= 3)", "word"),
    "changed_modality": f'SELECT * FROM (SELECT document_id, transformation_id, {_own("o")} AS "before", {_own("r")} AS "after" FROM {_P}) WHERE "before" <> "after"',
    "lexical_support": f"""SELECT document_id, transformation_id, round(CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(a) END, 6) AS support,
round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS similarity FROM (SELECT document_id, transformation_id, {_claims("r")} AS a, {_claims("o")} AS b FROM {_P})""",
    "identity_keys": f"SELECT document_id, sha256(source_relative_path || chr(1) || coalesce(title, chr(2)) || chr(1) || coalesce(CAST(page_or_slide_count AS VARCHAR), chr(2))) AS identity FROM {_D}",
    "common_folders": f"""WITH f AS (SELECT split_part(source_relative_path, '/', 1) AS source, string_split(regexp_replace(source_relative_path, '/[^/]*$', ''), '/') AS parts FROM {_D}),
g AS (SELECT source, min(parts) AS lo, max(parts) AS hi, count(DISTINCT parts) AS folders FROM f GROUP BY 1)
SELECT source, array_to_string(lo[1:coalesce(list_max(list_filter(range(1, least(len(lo), len(hi)) + 1), lambda i: lo[1:i] = hi[1:i])), 0)], '/') AS common, folders FROM g""",
}
