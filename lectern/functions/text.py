"""Scalar functions on text as column expressions, inside the JVM but for texts whose characters have to be composed or folded."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units that follow a number, whatever their case; the last is ours.
UNITS = ["mg", "g", "kg", "µg", "mcg", "ml", "l", "mmol", "mol", "ui", "iu", "mmhg", "cmh2o", "bpm", "hz", "mhz", "mm", "cm", "m", "%"]

#: Words that carry no claim.
STOP_WORDS = ["avec", "dans", "des", "elle", "est", "les", "leur", "mais", "pour", "que", "qui", "sont", "sur", "une"]

#: Words of denial and of obligation that a rewriting may not change.
NEGATIONS = ["ne", "pas", "jamais", "aucun", "sans", "ni"]
MODALS = ["toujours", "jamais", "obligatoire", "obligatoirement", "contre-indiqué", "contre-indiquée", "recommandé", "recommandée"]

#: Words that a rewriting may add to present its text.
PRESENTATION_WORDS = [
    "page", "slide", "table", "titre", "auteur", "enseignant", "institution", "contenu", "probablement", "dépendant", "image", "consulter", "document", "original", "texte", "incomplet", "illisible", "source", "extraite",
]

#: A letter, digit or underscore before or after the place; what ``\b`` and ``\w`` mean for them in Unicode.
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

#: White space of every kind.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

#: Bullet glyphs, private-use ones of presentation fonts included, and the line begin that is one.
BULLETS = "[-–—•●▪▫◦‣⁃❖\uf0d8\uf0fc✓]+|[-–—]?\\s*[\uf0b7\uf0a7\uf0ae]"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
SPLIT_WORD = rf"(?<=[\p{{L}}\p{{N}}_])-{SPACE}*\n{SPACE}*(?=[a-zà-öø-ÿ])"

#: Marks of a scanner, words that begin a caption or name a flow chart, notations that can't be trusted.
SCANNER = rf"(?i){_BEFORE}(?:CamScanner|Scanned\s+with|scanner){_AFTER}"
SCANNER_ONLY = r"(?i)^(?:CamScanner|Scanned\s+with\s+CamScanner)$"
CAPTION = rf"(?iu){_BEFORE}(?:figure|fig\.|sch[ée]ma|image|radiographie|scanner|photo)\s*\p{{Nd}}*"
FLOW = rf"(?iu){_BEFORE}(?:arbre|algorithme|conduite\s+[àa]\s+tenir|cause\s+[ée]vidente){_AFTER}"
AMBIGUOUS_NUMBER = rf"(?i){_BEFORE}\p{{Nd}}+\s{{2,}}(?:e\s*)?\p{{Nd}}+{_AFTER}"
BROKEN_FONT = rf"&[A-Za-z]{{3,}}|\x{{FFFD}}|\x00|{_BEFORE}[A-Za-z]\s+[A-Za-z]\s+[A-Za-z]\s+[A-Za-z]{_AFTER}"
MALFORMED_HEADING = r"^(?:I{1,4}|IV|V|VI{0,3}|IX|X)(?=[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ])"

#: What marks a teacher, an institution and an academic year.
TEACHER = rf"(?iu){_BEFORE}(?:(?:Pr(?:of(?:esseur)?)?\.?|Dr\.?)\s+[A-ZÀ-ÖØ-Þ]|Auteur\s*:)"
INSTITUTION = rf"(?iu){_BEFORE}(?:facult[ée]|universit[ée]|h[oô]pital|chu{_AFTER}|service\s+de|minist[eè]re|centre\s+r[ée]gional)"
ACADEMIC_YEAR = rf"{_BEFORE}(?:19|20)\p{{Nd}}{{2}}\s*[-–/]\s*(?:19|20)?\p{{Nd}}{{2}}{_AFTER}"

#: Page numbers, and numbers before a heading.
PAGE_NUMBER = r"(?i)^(?:page\s*)?\p{Nd}+(?:\s*/\s*\p{Nd}+)?$"
HEADING_NUMBER = r"^\s*(?:\p{Nd}+(?:\.\p{Nd}+)*[.)]?|[IVXLC]+[.)-]|[A-Z][.)])\s+\p{L}"

#: Numbers of a text, and numbers with their sign, comparison and per cent.
NUMBER = rf"{_BEFORE}(\p{{Nd}}+(?:[.,]\p{{Nd}}+)?){_AFTER}"
SIGNED_NUMBER = rf"{_BEFORE}([<>≤≥±+\-]?\p{{Nd}}+(?:[.,]\p{{Nd}}+)?(?:\s*[%‰])?){_AFTER}"


#: Nearly all text has none of these, which is told by two ranges; the rest is looked at closer.
_BEYOND = r"[\u0300-\u2012\u2027-\x{10ffff}]"
_BEYOND_FOLDED = r"[\u0130\u0149\u017f\u01f0\u0300-\u2012\u2027-\x{10ffff}]"


@lru_cache(maxsize=2)
def _unsettled(folded: bool) -> str:
    """A pattern of the characters that the composed (or also folded) form may change: marks, conjoining letters, and those whose own form differs."""
    differs = lambda x: not unicodedata.is_normalized("NFC", x) or (folded and x.casefold() != x.lower())
    runs: list[list[int]] = []
    for c in range(0xC0, 0x110000):
        if 0xAC00 <= c <= 0xD7A3 or 0xD800 <= c <= 0xDFFF or c == 0xDF or not differs(chr(c)):
            continue
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return r"[\p{M}\x{1100}-\x{11ff}" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs) + "]"


def _composed(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


def _caseless(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFC", t).casefold() for t in text.to_pylist()], pa.string())


def _settled(text: Column, plain: Column, rare, beyond: str, pattern: str) -> Column:
    """``plain``, but ``rare`` (an Arrow function) of texts with characters that need it; only those leave the JVM."""
    return F.coalesce(F.arrow_udf(rare, "string")(F.when(text.rlike(beyond) & text.rlike(pattern), text)), plain)


def nfc(text: Column) -> Column:
    """The text in composed form (NFC)."""
    return _settled(text, text, _composed, _BEYOND, _unsettled(False))


def fold_case(text: Column) -> Column:
    """The text composed and case-folded: what compares equal whatever its case."""
    plain = F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("µ"), F.lit("μ"))
    return _settled(text, plain, _caseless, _BEYOND_FOLDED, _unsettled(True))


def strip(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def line_ends(text: Column) -> Column:
    """All line ends as ``\\n``: CR LF, CR, next line, line and paragraph separators."""
    return F.regexp_replace(text, "\r\n|[\r\u0085\u2028\u2029]", "\n")


def blank(text: Column) -> Column:
    """Whether a text says nothing: null, empty or white space of any kind."""
    return ~F.coalesce(text.rlike(rf"[^{SPACE[1:-1]}]"), F.lit(False))


def normalize_text(text: Column) -> Column:
    """The composed text with paragraphs (parted by blank lines) as single lines with single spaces, joined by a blank line. Null stays null."""
    lines = F.regexp_replace(nfc(text), "\r\n?", "\n")
    one = lambda p: F.array_join(F.filter(F.transform(F.split(p, "\n"), lambda x: strip(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: x != ""), " ")
    return F.array_join(F.filter(F.transform(F.split(lines, rf"\n{SPACE}*\n"), one), lambda x: x != ""), "\n\n")


def text_hash(text: Column) -> Column:
    """SHA-256 of the normalised text."""
    return F.sha2(normalize_text(text), 256)


def token_estimate(characters: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.floor((characters + 3) / 4).cast("bigint")


def leading(text: Column, most: int) -> Column:
    """At most ``most`` characters from the start, cut at the last space if there is one; null for empty texts and for 0."""
    head = F.substring(text, 1, most + 1)
    space = F.length(head) - F.length(F.substring_index(head, " ", -1))  # position of the last space, 0 if none
    cut = F.rtrim(F.when(space > 1, F.substring(text, F.lit(1), space - 1)).otherwise(F.substring(text, 1, most)))
    return F.when((F.length(text) == 0) | F.lit(most == 0), None).when(F.length(text) <= most, text).otherwise(cut)


def trailing(text: Column, most: int) -> Column:
    """At most ``most`` characters from the end, begun after the first space among them; null for empty texts and for 0."""
    tail = F.substring(text, F.length(text) - most + 1, F.lit(most))
    space = F.instr(tail, " ")
    return F.when((F.length(text) == 0) | F.lit(most == 0), None).when(F.length(text) <= most, text).otherwise(F.ltrim(F.when(space > 0, F.substring(tail, space + 1, F.lit(most))).otherwise(tail)))


def key_text(text: Column) -> Column:
    """The composed, case-folded text with single spaces: what makes two lines equal."""
    return F.trim(F.regexp_replace(fold_case(text), rf"{SPACE}+", " "))


def cleaned(text: Column) -> Column:
    """``struct<text, transformation, reason>`` of one block of raw text.

    Line ends, control characters, words broken at a hyphen, white space and
    bullets are put right; lines are joined by a space unless some are table
    rows or bullets. The transformation is null where nothing changed.
    """
    plain = F.regexp_replace(line_ends(text), CONTROLS, "")
    whole = F.regexp_replace(plain, SPLIT_WORD, "")
    tidy = lambda x: strip(F.regexp_replace(x, "[ \\t\u00a0]+", " "))
    pointed = lambda x: F.when(x.rlike(f"^(?:{BULLETS})"), F.concat(F.lit("- "), F.regexp_replace(x, rf"^(?:{BULLETS}){SPACE}*", ""))).otherwise(x)
    lines = F.filter(F.transform(F.split(whole, "\n"), lambda x: pointed(tidy(x))), lambda x: x != "")
    rows = F.exists(lines, lambda x: F.contains(x, F.lit("|")) | F.startswith(x, F.lit("- ")))
    done = strip(F.when(rows, F.array_join(lines, "\n")).otherwise(F.array_join(lines, " ")))
    kind = F.when(done == text, None).when(whole != plain, "split_word_repair").otherwise("paragraph_reassembly")
    why = F.when(kind == "split_word_repair", "words broken at line ends were joined").when(kind == "paragraph_reassembly", "white space and lines were put right")
    return F.struct(done.alias("text"), F.when(text.isNotNull(), kind).alias("transformation"), F.when(text.isNotNull(), why).alias("reason"))


def clean_block(text: Column) -> Column:
    """The text of :func:`cleaned`."""
    return cleaned(text)["text"]


def metadata_class(text: Column, ordinal: Column) -> Column:
    """What a block is: ``teacher_name``, ``institution``, ``academic_year``, ``course_title`` (one of the first 18 blocks that looks like a title) or ``body_content``; ``ordinal`` counts from 0."""
    bare = F.regexp_replace(text, "^[ :-]+|[ :-]+$", "")
    title = (ordinal < 18) & F.length(bare).between(3, 180) & ~bare.rlike(r"^-|[.;]$") & (count_of(bare, r"\p{L}") >= 3)
    return F.when(text.rlike(TEACHER), "teacher_name").when(text.rlike(INSTITUTION), "institution").when(text.rlike(ACADEMIC_YEAR), "academic_year").when(title, "course_title").otherwise("body_content")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def words(text: Column) -> Column:
    """Runs of letters and digits, one apostrophe allowed inside, composed and case-folded."""
    return F.regexp_extract_all(fold_case(text), F.lit(r"([\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)?)"), F.lit(1))


def numbers(text: Column) -> Column:
    """Plain numbers with an optional decimal part that stand by themselves (``G1`` holds none)."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))


def signed_numbers(text: Column) -> Column:
    """Numbers with the sign or comparison before and the per cent or per mille behind them, white space inside as one space."""
    return F.transform(F.regexp_extract_all(text, F.lit(SIGNED_NUMBER), F.lit(1)), lambda x: F.regexp_replace(x, rf"{SPACE}+", " "))


def units(text: Column) -> Column:
    """The units that stand as words of their own, in lower case."""
    listed = "|".join(sorted((u for u in UNITS if u != "%"), key=lambda u: (-len(u), u)))
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?iu){_BEFORE}({listed}){_AFTER}"), F.lit(1)), F.lower)


def number_pattern(text: Column) -> Column:
    """A pattern that matches exactly the numbers of a text: longest first, then by value, dots escaped; empty where there are none."""
    by = F.transform(F.array_distinct(numbers(text)), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))
    return F.array_join(F.transform(F.array_sort(by), lambda s: F.replace(s["x"], F.lit("."), F.lit("\\."))), "|")


def measured(text: Column) -> Column:
    """Numbers with the unit that follows them, as ``5 mg``."""
    unit = "|".join(sorted((u for u in UNITS), key=lambda u: (-len(u), u)))
    found = F.regexp_extract_all(text, F.lit(rf"(\p{{Nd}}+(?:[.,]\p{{Nd}}+)?\s*(?i:{unit}))(?:[^\p{{L}}\p{{N}}]|$)"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, r"^([\p{Nd}.,]+)\s*", "$1 "))


def claim_words(text: Column) -> Column:
    """The set of words of three or more letters that are no stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_except(F.array_distinct(F.regexp_extract_all(fold_case(text), F.lit(r"(\p{L}{3,})"), F.lit(1))), stop)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; 1 for two empty ones."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")))


def contained(a: Column, b: Column) -> Column:
    """The share of ``a`` that is in ``b``; 0 for an empty ``a``."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(a).cast("double")), F.lit(0.0))


def script(text: Column) -> Column:
    """``fr+ar``, ``ar`` or ``fr`` by the letters of the text (Latin is the default)."""
    arabic, latin = count_of(text, r"[؀-ۿ]"), count_of(text, r"[A-Za-zÀ-ÿ]")
    return F.when((arabic > 0) & (latin > 0), "fr+ar").when(arabic > 0, "ar").otherwise("fr")


def alpha_ratio(text: Column) -> Column:
    """The share of letters among characters that are no white space; 0 where there are none."""
    return F.coalesce(F.try_divide(count_of(text, r"\p{L}").cast("double"), count_of(text, r"[^\s]").cast("double")), F.lit(0.0))


def single_letter_ratio(text: Column) -> Column:
    """The share of words (runs of letters) of one letter; 1 where there are no words."""
    w = F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), F.lit(1))
    return F.coalesce(F.try_divide(F.size(F.filter(w, lambda x: F.length(x) == 1)).cast("double"), F.size(w).cast("double")), F.lit(1.0))


def symbol_ratio(text: Column) -> Column:
    """The share of symbols and control characters among characters that are no white space; 0 where there are none."""
    return F.coalesce(F.try_divide(count_of(text, r"[\p{S}\p{Cc}&&[^\s]]").cast("double"), count_of(text, r"[^\s]").cast("double")), F.lit(0.0))


def is_heading(text: Column) -> Column:
    """Whether a line is a heading: short, numbered or mostly capitals, without a closing mark."""
    letters, upper = count_of(text, r"\p{L}"), count_of(text, r"\p{Lu}")
    short = (F.length(text) >= 3) & (F.length(text) <= 120) & ~text.rlike(r"[.;,]$") & (letters >= 3)
    return short & (text.rlike(HEADING_NUMBER) | (F.try_divide(upper.cast("double"), letters.cast("double")) >= 0.55))


def identity(*parts: Column) -> Column:
    """SHA-256 over the parts joined by a control character; a null part differs from an empty one."""
    return F.sha2(F.array_join(F.array(*[F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts]), "\u0001"), 256)


def shared_folders(first: Column, last: Column) -> Column:
    """The folders that two paths (arrays of parts) share, as one path; for the least and the greatest of a set, those that all share."""
    upto = F.filter(F.sequence(F.lit(1), F.least(F.size(first), F.size(last))), lambda i: F.slice(first, F.lit(1), i) == F.slice(last, F.lit(1), i))
    return F.array_join(F.slice(first, F.lit(1), F.size(upto)), "/")


def location_marker(kind: Column, number: Column, original: Column, mode: str) -> Column:
    """The mark of a location in a cleaned text: none (``remove``, and for whole documents), as it was (``keep``) or ``[Page n]`` (``compact``)."""
    if mode not in ("keep", "compact", "remove"):
        raise ValueError(f"no such mode: {mode}")
    if mode == "remove":
        return F.lit(None).cast("string")
    short = F.concat(F.when(kind == "page", "[Page ").otherwise("[Slide "), number.cast("string"), F.lit("]"))
    return F.when(~kind.isin("document", "source"), original if mode == "keep" else short)


def prompt_size(*parts: Column) -> Column:
    """``struct<characters, tokens>`` of a prompt made of these texts; null parts are empty."""
    n = F.lit(0)
    for p in parts:
        n = n + F.length(F.coalesce(p, F.lit("")))
    return F.struct(n.cast("bigint").alias("characters"), token_estimate(n).alias("tokens"))


def utc_stamp(at: Column) -> Column:
    """An instant as ISO 8601 in UTC."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
