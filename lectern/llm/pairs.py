"""Defective pairs of an original text and its rewriting."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.labels import language_code
from lectern.llm.labelmodel import Defect, label
from lectern.session import cut_lineage

#: What stands for nothing, letters and digits only.
STAND_INS = [
    "na", "nan", "nil", "none", "null", "empty", "blank", "nothing", "nooutput", "nocontent", "notext", "noanswer", "noresponse", "notavailable", "notapplicable", "undefined", "tbd", "todo", "missing", "placeholder", "emptystring", "emptyoutput", "noresult", "eos", "endoftext", "pad",
    "vide", "rien", "néant", "aucun", "aucunesortie", "aucuntexte", "aucunereponse", "aucuneréponse", "sanscontenu", "pasdetexte", "nonrenseigné", "sansobjet", "nd",
    "leer", "nichts", "keine", "keinausgabe", "keineausgabe", "keintext", "keineantwort", "keininhalt", "ohneinhalt", "entfällt", "ka",
    "vacío", "vacio", "nada", "ninguno", "sincontenido", "sintexto", "sinsalida", "sinrespuesta", "nodisponible", "noaplica",
    "فارغ", "لاشيء", "لايوجد",
]

#: Phrases of declining in the first person or about the request itself, lower case, by language.
REFUSALS = {
    "en": [
        r"\bi(?:'m| am)? (?:so |very |really )?sorry,? (?:but|i)\b", r"\bsorry, (?:but )?i\b", r"\bi (?:can't|cannot|can not|could not|couldn't|won't|will not|am unable|am not able|must decline|have to decline|do not feel|don't feel|refuse|decline|would rather not|prefer not|am not allowed|am not authori[sz]ed|may not)\b", r"\bi'm (?:unable|not able|not allowed)\b", r"\bas an? (?:ai|language model|assistant)\b", r"\bmy (?:guidelines|instructions|rules|policy|policies)\b", r"\bwhat i am allowed\b", r"\bappropriate for me\b", r"\bno (?:answer|response|reply) can be (?:given|provided)\b", r"\bthis (?:request|content|input) (?:can(?:not|'t)|falls outside|is not)\b",
    ],
    "fr": [
        r"\bje (?:ne peux|ne puis|ne suis pas (?:en mesure|autoris|habilit|capable)|ne saurais|ne souhaite pas|ne veux pas|refuse|regrette|dois (?:décliner|refuser)|préfère ne pas|suis (?:désolé|dans l'impossibilité|incapable))", r"\bil ne m'est pas\b", r"\bil m'est impossible\b", r"\bdésolée?,? (?:mais )?je\b", r"\ben tant qu[e'] ?(?:modèle|assistant|ia)\b", r"\bmodèle de langage\b", r"\bmes (?:consignes|instructions|règles|directives)\b", r"\baucune réponse ne peut\b", r"\bcette (?:demande|requête) (?:ne peut|dépasse)",
    ],
    "es": [
        r"\blo siento,? (?:pero )?(?:no|me)\b", r"\bno (?:puedo|estoy (?:autorizad|en condiciones|capacitad)|me (?:es posible|está permitido|siento cómod)|soy capaz)", r"\b(?:prefiero|quisiera) no\b", r"\b(?:debo|tengo que) (?:rechazar|declinar)\b", r"\bcomo (?:modelo|asistente|ia)\b", r"\bmodelo de lenguaje\b", r"\bmis (?:normas|instrucciones|directrices|reglas)\b", r"\bno se puede dar (?:una )?respuesta\b", r"\bme (?:resulta imposible|impiden)\b",
    ],
    "de": [
        r"\bich (?:kann|könnte|darf|möchte|will|werde) (?:[^.!?]{0,80} )?nicht\b", r"\b(?:kann|darf|möchte|werde) ich (?:[^.!?]{0,80} )?nicht\b", r"\bes tut mir leid\b", r"\bich bin (?:leider )?nicht (?:in der lage|befugt|berechtigt)\b", r"\bbin ich nicht (?:in der lage|befugt|berechtigt)\b", r"\bals (?:sprachmodell|ki|assistent)\b", r"\bmeine (?:richtlinien|vorgaben|anweisungen|regeln)\b", r"\bmuss ich (?:[^.!?]{0,80} )?ablehnen\b", r"\bich (?:muss|lehne) (?:[^.!?]{0,80} )?ab(?:lehnen)?\b", r"\bkeine antwort (?:gegeben|möglich)\b", r"\bist es mir nicht möglich\b", r"\bist mir nicht möglich\b",
    ],
    "": [
        r"\bnon posso\b", r"\bmi dispiace\b", r"\bnão posso\b", r"\bik kan (?:[^.!?]{0,60} )?niet\b", r"لا أستطيع", r"لا يمكنني", r"آسف", r"أعتذر",
    ],
}

#: Words by which a text speaks of itself, its writer or the request.
SELF_WORDS = [
    "i", "i'm", "my", "me", "guidelines", "request", "input", "slide", "content", "answer", "allowed", "authorised", "please", "teacher", "clinician", "sorry",
    "je", "j'ai", "m'est", "mes", "mon", "ma", "demande", "contenu", "réponse", "consignes", "désolé", "message", "diapositive", "clinicien", "moi",
    "ich", "mir", "mich", "meine", "meiner", "anfrage", "bitte", "inhalt", "antwort", "richtlinien", "vorlage", "auskunft", "nachricht",
    "yo", "mis", "mi", "solicitud", "petición", "contenido", "respuesta", "normas", "mensaje", "clínico",
]

#: What marks a text as cut, and words no sentence ends with.
CUT_MARK = r"(?i)(?:[\[(<]\s*(?:…|\.\.\.)\s*[\])>]|…|\.\.\.|,|;|:|-|–|\(|/|<[a-z_ ]*(?:tokens?|length|eos|cut)[a-z_ ]*>|[\[(<](?:truncated|tronqué|gekürzt|truncado|cut|cut off|suite|continued|continúa|continuará|fortsetzung|forts\.|wird fortgesetzt|more|cont\.?|à suivre|sigue)\W*[\])>])\s*$"
OPEN_WORDS = [
    "the", "a", "an", "of", "with", "and", "or", "to", "due", "for", "in", "by", "is", "are", "than", "that", "because", "at", "on", "under", "from", "as",
    "le", "la", "les", "un", "une", "des", "de", "du", "et", "ou", "avec", "en", "à", "par", "pour", "raison", "est", "sous", "dans", "au", "aux", "qui", "que", "ne", "vers", "sur",
    "der", "die", "das", "ein", "eine", "einen", "dem", "den", "und", "oder", "mit", "wegen", "von", "zu", "in", "im", "bei", "für", "ist", "nach", "um", "je", "dann",
    "el", "los", "las", "una", "y", "o", "con", "por", "para", "del", "al", "es", "se", "desde", "hacia", "como", "debido", "sin",
]

#: Function words by language, to which words learnt from the table are added.
FUNCTION_WORDS = {
    "en": ["the", "of", "and", "is", "with", "when", "that", "for", "should", "which", "this", "are", "was", "after", "by", "from", "patient", "notes", "times", "day", "weeks"],
    "fr": ["le", "la", "les", "des", "une", "est", "et", "lorsque", "pour", "avec", "dans", "du", "il", "ou", "puis", "après", "malade", "fois", "par", "jour", "semaines"],
    "de": ["der", "die", "das", "und", "ist", "wenn", "mit", "nach", "bei", "ein", "eine", "wird", "nicht", "den", "von", "zu", "kranke", "mal", "am", "tag", "wochen"],
    "es": ["el", "los", "las", "una", "y", "cuando", "con", "para", "del", "que", "se", "por", "no", "después", "enfermo", "paciente", "veces", "al", "día", "semanas"],
}

#: Learnt words kept for each language, and rows by which a word's share is drawn towards 0.
LANGUAGE_WORDS, SMOOTHING = 300, 10

#: The weight of a known function word, and the greatest of a learnt one.
KNOWN = 0.1

_WORDS, _NOT_ALNUM, _FIGURES = re.compile(r"(?:[^\W\d_]|')+"), re.compile(r"[\W_]+"), re.compile(r"\d+")
_LIST, _TABLE, _CLOSED = re.compile(r"\s*[-•*] "), re.compile(r"\s*\|"), re.compile(r"[.!?؟。][\"'»”)\]]*$")
_CUT, _WORD_CHAR, _ARABIC = re.compile(CUT_MARK), re.compile(r"\w"), re.compile(r"[\u0600-\u06ff]")
_OPENS, _CLOSES = re.compile(r"[<\[({«\"`]"), re.compile(r"[>\])}»\"`]")
_REFUSALS = {k: re.compile("|".join(v)) for k, v in REFUSALS.items()}
_STAND_INS, _SELF, _OPEN = frozenset(STAND_INS), frozenset(SELF_WORDS), frozenset(OPEN_WORDS)

#: What is believed of every labelling function before any row is seen: votes of 1 on defective and on sound rows.
BELIEFS = [
    Defect("empty", 0.03, {"no_content": (0.55, 0.0005), "stand_in": (0.97, 0.0005), "wrapped": (0.75, 0.001)}),
    Defect("refusal", 0.04, {"phrase": (0.95, 0.002), "no_figures": (0.8, 0.04), "self": (0.8, 0.02), "shape": (0.97, 0.4)}),
    Defect("copy", 0.04, {"same": (0.8, 0.0005), "inside": (0.97, 0.001), "words": (0.9, 0.01)}),
    Defect("truncated", 0.05, {"unclosed": (0.9, 0.003), "mark": (0.6, 0.0005), "open_word": (0.3, 0.0005), "rare_end": (0.85, 0.003)}),
    Defect("other_language", 0.04, {"original": (0.9, 0.01), "document": (0.85, 0.005), "siblings": (0.95, 0.003)}),
]


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def language_of(words: set[str], text: str, marks: dict[str, list[tuple[str, float]]]) -> str | None:
    """The language whose words in the text weigh most: two at least, and more than those of any other; else none. ``marks`` gives the languages of a word and its weight in each."""
    if len(_ARABIC.findall(text)) * 2 > len(text) > 0:
        return "ar"
    score: dict[str, list[float]] = {}
    for w in words:
        for k, weight in marks.get(w, ()):
            s = score.setdefault(k, [0.0, 0])
            s[0] += weight
            s[1] += 1
    order = sorted(((round(v, 9), n, k) for k, (v, n) in score.items()), key=lambda x: (-x[0], x[2]))
    return order[0][2] if order and order[0][1] >= 2 and (len(order) == 1 or order[0][0] > order[1][0]) else None


def _vote(yes: bool, no: bool | None = None) -> str:
    return "+" if yes else "-" if no is None or no else "0"


def wrapped(text: str) -> bool:
    """Whether nothing but one pair of brackets or quotes, with whatever is in it, or no word at all makes up the text."""
    begin = _OPENS.search(text)
    if not begin:
        return not _WORD_CHAR.search(text)
    end = max((text.rfind(c) for c in ">])}»\"`"), default=-1)
    outside = text[: begin.start()] + (text[end + 1 :] if end > begin.start() else text[begin.start() :])
    return not _WORD_CHAR.search(outside)


@dataclass(frozen=True)
class Seen:
    """What one look at a pair shows: the votes of all functions but three, which other rows decide, and what those are about."""

    votes: list[str]
    language: str | None
    original_language: str | None
    end: str
    loose_end: bool
    closed: bool


def look_at(o: str | None, r: str | None, marks: dict[str, list[tuple[str, float]]]) -> Seen:
    """Look at an original and its rewriting once.

    ``votes`` are those of ``empty``, ``refusal``, ``copy`` and ``truncated``
    in the order of BELIEFS, without ``rare_end``.
    """
    o, r = o or "", r or ""
    bare_o, bare_r = _NOT_ALNUM.sub("", o.lower()), _NOT_ALNUM.sub("", r.lower())
    n_o, n_r, tail = len(bare_o), len(bare_r), r.rstrip()
    words_r, words_o = words_of(r), words_of(o)
    set_r, set_o = set(words_r), set(words_o)
    r_lang, o_lang = language_of(set_r, r, marks), language_of(set_o, o, marks)

    nothing = n_r == 0 or bare_r in _STAND_INS
    empty = _vote(n_r == 0) + _vote(nothing, n_r > 0) + _vote(len(words_r) <= 2 and wrapped(r), len(words_r) > 3)

    is_list, is_table = bool(_LIST.match(tail)) and "\n" in tail, bool(_TABLE.match(tail))
    plain = r.lower().replace("’", "'")
    phrase = any(p.search(plain) for k, p in _REFUSALS.items() if r_lang is None or not k or k == r_lang or r_lang not in _REFUSALS)
    figures = set(_FIGURES.findall(o))
    carried = len(figures & set(_FIGURES.findall(r)))
    selves = len(set_r & _SELF)
    listed = is_list or is_table
    refusal = _vote(phrase) + _vote(len(figures) > 1 and not carried and len(words_r) >= 4, carried >= 2) + _vote(selves >= 2, not selves) + _vote(4 <= len(words_r) <= 60 and not listed and ":" not in r, listed)

    shared = len(set_r & set_o)
    inside = n_o >= 8 and bare_o in bare_r and n_r <= n_o * 1.6 + 24
    copy = _vote(n_o > 0 and bare_r == bare_o) + _vote(inside, n_o < 8 or bare_o not in bare_r) + _vote(len(set_r) >= 3 and shared >= 0.9 * len(set_o) and shared >= 0.7 * len(set_r), shared < 0.5 * len(set_r))

    marked = n_r > 0 and bool(_CUT.search(tail))
    closed = not marked and bool(_CLOSED.search(tail))
    heading = "\n" not in tail and len(words_r) <= 8 and not re.search(r"[.!?]", tail)
    lines = tail.split("\n")
    ragged = is_table and (lines[-1].count("|") < lines[0].count("|") or not tail.endswith("|") or len(lines) < 2)
    prose = not (is_list or is_table or heading or nothing)
    loose = not closed and len(words_r) > 2 and (words_r[-1] in _OPEN or r.count("(") > r.count(")"))
    truncated = _vote((prose and not closed) or ragged, closed or (is_table and not ragged)) + _vote(marked) + _vote(loose, closed)
    return Seen([empty, refusal, copy, truncated], r_lang, o_lang, words_r[-1] if words_r else "", not closed and not is_table and not nothing and len(words_r) > 2, closed)


def language_words(rows: DataFrame, language: str, texts: list[str], per_language: int = LANGUAGE_WORDS) -> dict[str, dict[str, float]]:
    """For each language that labels any row the words that mark it most with their weights, learnt from all labelled rows.

    A word's weight is its share of the rows of the language, drawn towards 0
    by ``SMOOTHING`` rows, less its greatest share in any other. Counts are
    made over all rows and all languages; the driver gets ``per_language``
    words (the size of a language's model) for each. Known function words
    weigh ``KNOWN``, learnt ones no more, since words of a subject can mark a
    language as much as words of the language.
    """
    told = rows.filter(F.col(language).isNotNull())
    kept = {r[language]: r["rows"] for r in told.groupBy(language).agg(F.count(F.lit(1)).alias("rows")).collect()}
    if not kept:
        return {k: dict.fromkeys(v, KNOWN) for k, v in FUNCTION_WORDS.items()}
    size = F.create_map(*[F.lit(v) for k, n in sorted(kept.items()) for v in (k, n + SMOOTHING)])
    both = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", *texts)), F.lit(r"[\p{L}\p{M}']+"), F.lit(0)))
    uses = told.select(language, F.explode(both).alias("word")).filter(F.length("word") > 1).groupBy("word", language).agg(F.count(F.lit(1)).alias("n"))
    shares = uses.select("word", F.struct((F.col("n") / size[F.col(language)]).alias("share"), F.col(language).alias("l")).alias("x"))
    by = shares.groupBy("word").agg(F.max("x").alias("top"))
    second = shares.join(by.select("word", F.col("top.l").alias("l"), F.col("top.share").alias("share")), "word").filter(F.col("x.l") != F.col("l")).groupBy("word").agg(F.max("x.share").alias("second"))
    ranked = by.select("word", F.col("top.l").alias("l"), F.col("top.share").alias("share")).join(second, "word", "left").select("word", "l", (F.col("share") - F.coalesce("second", F.lit(0.0))).alias("weight")).filter("weight > 0")
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("weight"), "word"))
    learnt: dict[str, dict[str, float]] = {k: dict.fromkeys(v, KNOWN) for k, v in FUNCTION_WORDS.items()}
    for r in ranked.withColumn("place", place).filter(F.col("place") <= per_language).collect():
        own = learnt.setdefault(r["l"], {})
        own.setdefault(r["word"], min(r["weight"], KNOWN))
    return learnt


def defective_pairs(pairs: DataFrame, languages: DataFrame) -> DataFrame:
    """``document_id, transformation_id, labels``: every defect of a pair with its posterior.

    ``pairs``: ``document_id, transformation_id, original_text,
    reconstructed_text``, one row per pair; ``languages``: ``document_id,
    language`` (labels of any spelling). Labels come in the order ``empty,
    refusal, copy, truncated, other_language``, in which an earlier one
    explains a later one: a copy or a refusal is also unfinished, a cut
    answer is no full answer in another language. A null or blank rewriting is
    empty, a null original can't be copied; pairs of unknown language make no
    case of ``other_language``; repeated rows are labelled repeatedly.

    Texts are read twice, for the words of the languages and for one look in
    Python, and never shuffled here: what other rows decide (how often a text
    ends on a word, what the originals of a document are written in) is joined
    to the votes, and only for rows that are in doubt.
    """
    told = languages.select("document_id", F.regexp_extract(language_code(F.col("language")), r"^([a-z]+)", 1).alias("doc_lang")).withColumn("doc_lang", F.nullif("doc_lang", F.lit("und")))
    base = pairs.select("document_id", "transformation_id", F.col("original_text").alias("o"), F.col("reconstructed_text").alias("r")).join(told, "document_id", "left")
    marks: dict[str, list[tuple[str, float]]] = {}
    for k, ws in sorted(language_words(base, "doc_lang", ["o", "r"]).items()):
        for w, weight in ws.items():
            marks.setdefault(w, []).append((k, weight))

    @F.pandas_udf("struct<votes:array<string>,r_lang:string,o_lang:string,end:string,loose_end:boolean,closed:boolean>")
    def look(o: pd.Series, r: pd.Series) -> pd.DataFrame:
        each = [look_at(a, b, marks) for a, b in zip(o, r)]
        return pd.DataFrame([(x.votes, x.language, x.original_language, x.end, x.loose_end, x.closed) for x in each], columns=["votes", "r_lang", "o_lang", "end", "loose_end", "closed"])

    seen = cut_lineage(base.withColumn("x", look("o", "r")).select("document_id", "transformation_id", "doc_lang", "x.*"))
    main = seen.filter("o_lang is not null").groupBy("document_id", "o_lang").agg(F.count(F.lit(1)).alias("n")).groupBy("document_id").agg(F.max_by("o_lang", F.struct("n", "o_lang")).alias("main_lang"))
    ends = seen.filter("end <> ''").groupBy("end").agg(F.count(F.lit(1)).alias("end_uses"))
    doubt = lambda c: F.when(~F.col("closed") & (F.col("end") != ""), F.col(c))
    rows = seen.withColumn("asked", doubt("end")).join(ends.withColumnRenamed("end", "asked"), "asked", "left").join(main, "document_id", "left")
    rare = F.when(F.col("closed"), "-").when(F.col("loose_end") & (F.col("end_uses") < 3), "+").when(F.col("end_uses") >= 10, "-").otherwise("0")
    other = F.concat(*[F.when(F.col("r_lang").isNull() | F.col(c).isNull(), "0").when(F.col("r_lang") != F.col(c), "+").otherwise("-") for c in ("o_lang", "doc_lang", "main_lang")])
    columns = [F.col("votes")[i].alias(d.name) for i, d in enumerate(BELIEFS[:3])]
    voted = rows.select("document_id", "transformation_id", *columns, F.concat(F.col("votes")[3], rare).alias("truncated"), other.alias("other_language"))
    return label(cut_lineage(voted), BELIEFS, ["document_id", "transformation_id"])


def one_defect(labelled: DataFrame) -> DataFrame:
    """``document_id, transformation_id, defect`` of every pair with a label: the likeliest, of posteriors that agree in two decimals the first."""
    by = F.transform("labels", lambda x, i: F.struct((-F.round(x["posterior"], 2)).alias("p"), i.alias("i"), x["defect"].alias("defect")))
    return labelled.filter(F.size("labels") > 0).select("document_id", "transformation_id", F.array_min(by)["defect"].alias("defect"))
