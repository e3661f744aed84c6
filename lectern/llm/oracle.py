"""SQL of the training-text queries, where SQL can express them.

Label models, sequence models, dynamic programs, tokenizers, flows and
classifiers are no SQL; their queries are held against brute force, exact
round trips and held-out accuracy in the tests.
"""

from __future__ import annotations

import unicodedata

from lectern.functions.labels import LANGUAGE_NAMES
from lectern.llm.lookalike import BOUND, JOINED, LOOKALIKES, UNSEEN

_FROM = "".join(LOOKALIKES) + "".join(map(chr, range(0xFF01, 0xFF5F)))
_TO = "".join(LOOKALIKES.values()) + "".join(map(chr, range(0x21, 0x7F)))
_SPACES = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
_UNSEEN = "".join(rf"\x{{{c:x}}}" for c in UNSEEN)
_LIGATURES = {**{chr(c): unicodedata.normalize("NFKD", chr(c)) for c in range(0x2160, 0x2180)}, "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def _form(x: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    for a, b in _LIGATURES.items():
        x = f"replace({x}, '{a}', '{b}')"
    x = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    for _ in range(2):  # a joiner between letters that it parts or binds is drawn
        for c, kept in (("\\x{200c}", "\ue00c"), ("\\x{200d}", "\ue00d")):
            x = f"regexp_replace({x}, '([{JOINED if kept == chr(0xE00C) else BOUND}]){c}([{JOINED if kept == chr(0xE00C) else BOUND}])', '\\1{kept}\\2', 'g')"
    x = f"translate(regexp_replace({x}, '[{_UNSEEN}]', '', 'g'), '\ue00c\ue00d', '\u200c\u200d')"
    return f"nfc_normalize(translate(translate({x}, {quoted(_SPACES)}, {quoted(' ' * len(_SPACES))}), {quoted(_FROM)}, {quoted(_TO)}))"


def _language(x: str) -> str:
    known = "MAP {" + ", ".join(f"'{name}': '{code}'" for code, names in LANGUAGE_NAMES.items() for name in names) + "}"
    base = r"regexp_extract(trim(y, ' '), '^(\p{L}+)', 1)"
    joined = f"array_to_string(list_filter(list_transform(string_split(lower(trim({x}, ' ')), '+'), lambda y: coalesce({known}[{base}], {base})), lambda y: y <> ''), '+')"
    return f"CASE WHEN {x} IS NULL OR {joined} IN ('', 'unknown', 'none', 'null', 'mul', 'zxx') THEN 'und' ELSE {joined} END"


def _path(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(trim(lower(url_decode({x})), ' '), ' *[\\/]+ *', '/', 'g'), '^(\./)+', ''), '^/', '')"


_BLOCKS = "SELECT document_id, block_id, arg_max(struct_pack(text := text, source_excerpt := source_excerpt), ingested_at) AS b FROM blocks GROUP BY 1, 2"

_NOTICES = r"""WITH d AS (SELECT document_id, arg_max(split_part(source_relative_path, '/', 1), ingested_at) AS source, arg_max(classification, ingested_at) AS classification FROM normalized_documents GROUP BY 1),
s AS (SELECT document_id, source FROM d WHERE classification IS DISTINCT FROM 'likely_scanned'),
size AS (SELECT source, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT DISTINCT document_id, block_id, page, reading_order, text FROM blocks WHERE block_type NOT IN ('title', 'heading') OR block_type IS NULL),
l AS (SELECT document_id, block_id, page, reading_order, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM b WHERE text IS NOT NULL),
k AS (SELECT s.source, l.document_id, l.block_id, l.page, l.reading_order, l.line_no, array_to_string(regexp_extract_all(lower(l.line), '\p{L}+'), ' ') AS line_key FROM l JOIN s USING (document_id) WHERE len(regexp_extract_all(l.line, '\p{L}+')) >= 3),
kept AS (SELECT k.source, k.line_key FROM k JOIN size USING (source) GROUP BY 1, 2, size.n HAVING count(DISTINCT document_id) >= 3 AND count(DISTINCT document_id) * 20 >= size.n),
found AS (SELECT k.document_id, k.block_id, k.line_no FROM k JOIN kept USING (source, line_key))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": "SELECT DISTINCT c.document_id, c.chunk_id FROM chunks c JOIN chunking_configurations g USING (config_id) WHERE length(c.text) > g.hard_max_characters",
        "p3_checks": "SELECT DISTINCT c.document_id, c.chunk_id, true AS whole, true AS within, true AS shared FROM chunks c JOIN chunking_configurations g USING (config_id) WHERE length(c.text) > g.hard_max_characters",
        "p4_found": _NOTICES + "SELECT document_id, block_id, CAST(line_no AS INTEGER) AS line_no FROM found",
        "p4_texts": _NOTICES
        + f""", t AS (SELECT document_id, block_id, b.text AS text FROM ({_BLOCKS})),
f AS (SELECT document_id, block_id, list(line_no) AS gone FROM found GROUP BY 1, 2)
SELECT t.document_id, t.block_id, CASE WHEN f.gone IS NULL THEN t.text ELSE array_to_string(list_filter(string_split(t.text, chr(10)), lambda x, i: NOT list_contains(f.gone, i)), chr(10)) END AS text
FROM t LEFT JOIN f USING (document_id, block_id)""",
        "p4_blocks": _NOTICES.replace("WITH ", "WITH RECURSIVE ", 1)
        + """, occ AS (SELECT DISTINCT source, document_id, block_id, page, reading_order, line_no, line_key FROM k JOIN kept USING (source, line_key)),
e0 AS (SELECT source, document_id, line_key AS a, lead(line_key) OVER (PARTITION BY source, document_id, page ORDER BY reading_order NULLS FIRST, block_id, line_no) AS b FROM occ),
e1 AS (SELECT source, a, b FROM e0 JOIN size USING (source) WHERE b IS NOT NULL AND a <> b GROUP BY source, a, b, size.n HAVING count(DISTINCT document_id) >= 3 AND count(DISTINCT document_id) * 20 >= size.n),
e2 AS (SELECT source, a, b FROM e1 UNION SELECT source, b, a FROM e1),
reach AS (SELECT source, line_key AS node, line_key AS r FROM kept UNION SELECT reach.source, node, e2.b FROM reach JOIN e2 ON e2.source = reach.source AND e2.a = reach.r),
comp AS (SELECT source, node AS line_key, min(r) AS component FROM reach GROUP BY 1, 2),
o2 AS (SELECT source, document_id, component, CASE WHEN component IS DISTINCT FROM lag(component) OVER (PARTITION BY source, document_id, page ORDER BY reading_order NULLS FIRST, block_id, line_no) THEN 1 ELSE 0 END AS fresh FROM occ JOIN comp USING (source, line_key))
SELECT source, lines, documents, pieces FROM (SELECT source, component, count(*) AS lines FROM comp GROUP BY 1, 2) JOIN (SELECT source, component, count(DISTINCT document_id) AS documents, CAST(sum(fresh) AS BIGINT) AS pieces FROM o2 GROUP BY 1, 2) USING (source, component)""",
        "p7_counts": f"""WITH n AS (SELECT document_id, arg_max(struct_pack(v := language), ingested_at).v AS lang FROM normalized_documents GROUP BY 1),
c AS (SELECT chunk_id, x.* FROM (SELECT chunk_id, arg_max(struct_pack(document_id := document_id, t := coalesce(text, ''), p := source_relative_path, d := document_type), generated_at) AS x FROM chunks GROUP BY 1)),
i AS (SELECT 'chunk' AS item_kind, t, nullif(split_part({_path("p")}, '/', 1), '') AS source, {_language("lang")} AS language, NULL AS domain, lower(trim(d, ' ')) AS document_type FROM c LEFT JOIN n USING (document_id)
UNION ALL SELECT 'document', coalesce(text, ''), {_path("source")}, {_language("lang")}, lower(trim(domain, ' ')), lower(trim(document_type, ' ')) FROM documents)
SELECT item_kind, dimension, slice, count(*) AS items, count(DISTINCT t) AS texts FROM (SELECT item_kind, t, unnest([struct_pack(k := 'source', v := source), struct_pack(k := 'language', v := language), struct_pack(k := 'domain', v := domain), struct_pack(k := 'document_type', v := document_type)]) AS s FROM i) CROSS JOIN LATERAL (SELECT s.k AS dimension, coalesce(s.v, '(none)') AS slice) WHERE item_kind <> 'chunk' OR dimension <> 'domain' GROUP BY 1, 2, 3""",
        "p9_limits": "SELECT DISTINCT mix_name, source, true AS repeats_kept, true AS shares_whole FROM mixture_targets",
        "p6_found": f"""SELECT document_id, block_id FROM ({_BLOCKS})
WHERE NOT contains(b.text, b.source_excerpt) AND trim({_form("b.source_excerpt")}) <> '' AND contains({_form("b.text")}, {_form("b.source_excerpt")})""",
        "p6_texts": f"SELECT document_id, block_id, {_form('b.text')} AS text_form, {_form('b.source_excerpt')} AS source_excerpt_form FROM ({_BLOCKS})",
    }
