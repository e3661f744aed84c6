from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import lookalike


def form(*texts):
    return lookalike.normal_array(pa.array(list(texts), pa.string())).to_pylist()


def test_what_looks_the_same_becomes_the_same():
    same = ["déjà office", "déjà office", "ｄéｊà　oﬃce", "d​é­jà office﻿", "déjа̀ оffiсе"]
    assert set(form(*same)) == {"déjà office"}


def test_undrawn_characters_of_all_planes_go():
    assert form("a\U000e0100b\U000e0041c\u3164d\uffa0\u115f", "Ⅻ Ꭺ") == ["abcd", "XII A"]
    assert form("می\u200cخواهم", "a\u200cb", "ب\u200dب", "क्\u200dष", "\u200cب") == ["می\u200cخواهم", "ab", "بب", "क्\u200dष", "ب"]


def test_what_looks_different_stays_different():
    kept = ["m2", "m²", "M2", "deja", "déjà", "a  b", "a b", "a\nb", "½", "Straße", "(1)", "①"]
    assert form(*kept) == kept


def test_nulls_empties_line_ends_and_slices():
    assert form(None, "", "a\r\nb\rc", "​") == [None, "", "a\nb\nc", ""]
    part = pa.array(["x", None, "е́", "y"], pa.string()).slice(1, 2)
    assert lookalike.normal_array(part).to_pylist() == [None, "é"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(min_codepoint=0x41, max_codepoint=0x6FF, categories=["Lu", "Ll", "Lo", "Mn", "Nd"]), max_size=12), max_size=5))
def test_composition_is_that_of_unicode(texts):
    plain = [t for t in texts if not any(c in lookalike.LOOKALIKES or ord(c) in lookalike.UNSEEN for c in unicodedata.normalize("NFD", t)) and not any(unicodedata.decomposition(c).startswith("<") for c in t)]
    assert form(*plain) == [unicodedata.normalize("NFC", t) for t in plain]


def test_syllables_and_vowel_signs():
    for t in ("한국어 각", "কো", "ୋ"):
        assert form(unicodedata.normalize("NFD", t), t) == [unicodedata.normalize("NFC", t)] * 2


def test_rows_do_not_touch_each_other():
    assert form("e", "́", "á̧", "á̧") == ["e", "́", *[unicodedata.normalize("NFC", "á̧")] * 2]


def test_disguised_excerpts(spark):
    rows = [(1, "Un mot ici", "mot ici"), (2, "Un mot ici", "mot ici"), (3, "Un mot ici", "MOT ici"), (4, None, "x"), (5, "x", None), (6, "x", "​"), (7, "x" * 100_000 + "о", "xo"), (1, "Un mot ici", "mot ici")]
    df = spark.createDataFrame(rows, "id int, text string, e string").selectExpr("*", "1 as _text_form", "2 as text_form")
    got = sorted(r.id for r in lookalike.disguised_excerpts(df, ["id"], "text", "e").collect())
    assert got == [1, 1, 7]
    assert lookalike.disguised_excerpts(df.limit(0), ["id"], "text", "e").count() == 0
    whole = lookalike.one_form(df, ["text"]).filter("id = 4").collect()
    assert len(whole) == 1 and whole[0].text_form is None
