from __future__ import annotations

import os

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import tokens
from lectern.llm.fragments import FragmentTokenizer, forced_cuts, tokenizer

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.RANKS), reason="no tokenizer files here")

HARD = ["", None, "  a", "a  b", "x'sy", "it's  'll", "?'s", "§'re", "né e", "a　b  c", "<|endoftext|> x", "́́", "🙂🙂", "١٢٣ ٤", "a" * 50_000, "\r\n\t \n x", "ſ's", "中文 字", "a\u0085b"]


def plain(text):
    return tokenizer(tokens.RANKS).encoding.encode_ordinary(text or "")


def test_ids_equal_the_plain_encoder():
    got = tokenizer(tokens.RANKS).encode(pa.array(HARD, pa.string()))
    assert got.to_pylist() == [plain(t) for t in HARD]
    assert tokenizer(tokens.RANKS).counts(pa.array(HARD, pa.string())).tolist() == [len(plain(t)) for t in HARD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab'sretldmvLÉé \t\n\r  　.,!?0١ſ中́🙂§​", max_size=25), max_size=6))
def test_ids_equal_the_plain_encoder_on_any_text(texts):
    assert tokenizer(tokens.RANKS).encode(pa.array(texts, pa.string())).to_pylist() == [plain(t) for t in texts]


def test_slices_and_offsets():
    whole = pa.array(["drop", *HARD, "drop"], pa.string()).slice(1, len(HARD))
    assert tokenizer(tokens.RANKS).encode(pa.chunked_array([whole, whole])).to_pylist() == 2 * [plain(t) for t in HARD]


def test_forced_cuts_never_lie_inside_a_token():
    cut = forced_cuts({b"ab": 1, b"b": 2, b" x": 3}).reshape(256, 256)
    assert not cut[ord("a"), ord("b")] and cut[ord("b"), ord("a")] and cut[ord("a"), ord(" ")]
    assert not cut[ord(" "), ord("b")] and not cut[ord("a"), ord("'")] and not cut[ord("a"), 0x80]


def test_encode_corpus_cases(spark):
    rows = [(1, "x y", "k"), (1, "x y", "k"), (2, "", "k"), (3, None, None), (None, "z", "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids)) for r in tokens.encode_corpus(df).collect()), key=str)
    assert got == sorted([(1, plain("x y")), (1, plain("x y")), (2, []), (3, []), (None, plain("z"))], key=str)
    assert tokens.encode_corpus(df.limit(0)).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_totals_count_a_text_once_in_a_slice(spark):
    rows = [(1, "one two", "a", "fr"), (2, "one two", "a", "fr"), (3, "one two", "b", None), (4, None, "b", "fr"), (5, "", "b", "fr")]
    df = spark.createDataFrame(rows, "id bigint, text string, source string, language string")
    got = {(r.dimension, r.slice): (r["items"], r.texts, r.tokens, r.tokens_with_copies) for r in tokens.token_totals(df, {"source": "source", "lang": "language"}).collect()}
    n = len(plain("one two"))
    assert got == {("source", "a"): (2, 1, n, 2 * n), ("source", "b"): (3, 2, n, n), ("lang", "fr"): (4, 2, n, 2 * n), ("lang", "(none)"): (1, 1, n, n)}
    assert tokens.token_totals(df.limit(0), {"source": "source"}).count() == 0
    each = {r.id: r.n_tokens for r in tokens.token_table(df, ["id"]).collect()}
    assert each == {1: n, 2: n, 3: n, 4: 0, 5: 0}


def test_encoder_keeps_no_more_than_it_may():
    own = FragmentTokenizer(tokens.RANKS)
    own.known = {str(i): [i] for i in range(500_000)}
    assert own.encode(pa.array(["new words"])).to_pylist() == [plain("new words")]
    assert len(own.known) < 10
