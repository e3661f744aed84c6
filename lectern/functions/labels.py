"""One name for each language, path and source, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names under which a language may appear, beside its code and code with region.
LANGUAGE_NAMES = {
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "en": ["en", "eng", "english"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "es": ["es", "spa", "spanish", "español", "espanol"],
    "ar": ["ar", "ara", "arabic"],
}


def language_code(label: Column) -> Column:
    """``fr``, ``fr-FR``, ``FRA``, ``french`` -> ``fr``.

    Several languages joined by ``+`` keep their order (``fr+ar``). Null,
    blank and unusable labels (``und``) become ``und``; other labels stay, in
    lower case and without region.
    """
    pairs = [v for code, names in LANGUAGE_NAMES.items() for name in names for v in (F.lit(name), F.lit(code))]
    known = F.create_map(*pairs)
    base = lambda x: F.regexp_extract(F.trim(x), r"^(\p{L}+)", 1)
    parts = F.transform(F.split(F.lower(F.trim(label)), r"\+"), lambda x: F.coalesce(F.try_element_at(known, base(x)), base(x)))
    joined = F.array_join(F.filter(parts, lambda x: x != ""), "+")
    return F.when(label.isNull() | joined.isin("", "unknown", "none", "null", "mul", "zxx"), F.lit("und")).otherwise(joined)


def clean_path(path: Column) -> Column:
    """One spelling of a relative path: ``%2D`` and the like decoded, ``\\`` as ``/``, no ``./``, leading or double slashes, lower case."""
    plain = F.lower(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(plain), r"\s*[\\/]+\s*", "/"), r"(^|/)(\./)+", "$1"), r"^/", "")


def source_of(path: Column) -> Column:
    """The source of a document: the first segment of its cleaned path; null for null and blank paths."""
    return F.nullif(F.element_at(F.split(clean_path(path), "/"), 1), F.lit(""))
