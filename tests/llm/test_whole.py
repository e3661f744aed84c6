"""Cases that a cut of the input or of the rule would lose."""

from __future__ import annotations

import os

import pytest

from lectern.llm import mixture, tokens


@pytest.mark.skipif(not os.path.exists(tokens.RANKS), reason="no tokenizer files here")
def test_a_text_of_many_sources_counts_for_all_of_them(spark):
    few = [f"s{i}" for i in range(6)]
    rows = [(i, "a notice that all copy " * 30, s) for i, s in enumerate([*few, "wide"])]
    rows += [(100 + i, f"text number {i} " + "word " * 20, "wide") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("m", "wide", 1.0, 1), *[("n", s, 1 / 6, 6) for s in few]], "mix_name string, source string, target_share double, max_repeats int")
    found = {tuple(m["source"] for m in r.members) for r in mixture.texts_by_pattern(docs, [*few, "wide"], "doc_id", "text", "source").collect()}
    assert found == {("wide",), (*few, "wide")}
    chosen = mixture.mix_sources(docs, targets).collect()
    assert {r.doc_id for r in chosen if r.mix_name == "m"} == {6, *range(100, 120)}
    assert {(r.source, r.copies) for r in chosen if r.mix_name == "n"} == {(s, 1) for s in few}


@pytest.mark.skipif(not os.path.exists(tokens.RANKS), reason="no tokenizer files here")
def test_patterns_that_agree_in_a_mix_are_laid_end_to_end(spark):
    rows = [(i, f"text number {i} " + "word " * 20, "a") for i in range(40)]
    rows += [(1000 + i, rows[i][1], s) for i, s in enumerate(["x", "y", "z", "x"] * 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("m", "a", 1.0, 2), *[("n", s, 1 / 3, 1) for s in "xyz"]], "mix_name string, source string, target_share double, max_repeats int")
    chosen = mixture.mix_sources(docs, targets).filter("mix_name = 'm'").collect()
    assert sorted((r.doc_id, r.copies) for r in chosen) == [(i, 2) for i in range(40)]
