from __future__ import annotations

import os

import pytest

from lectern.llm import mixture, tokens


def test_shares_are_met_with_fewest_repeats():
    sizes = {("a",): 100, ("b",): 1000, ("a", "b"): 50}
    flows = mixture.route(sizes, {"a": 0.5, "b": 0.5}, {"a": 3, "b": 1})
    a, b = (sum(n for (_, s), n in flows.items() if s == x) for x in "ab")
    assert a == b == 450 and flows[("a", "b"), "a"] == 150
    fixed = mixture.route(sizes, {"a": 0.5, "b": 0.5}, {"a": 3, "b": 1}, total=300)
    assert fixed[("a",), "a"] == 100 and fixed[("a", "b"), "a"] == 50


def test_quotas_beyond_the_repeats_are_met_as_far_as_they_can():
    flows = mixture.route({("a",): 10, ("b",): 1000}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 1}, total=1000)
    assert flows == {(("a",), "a"): 20, (("b",), "b"): 500}


def test_sources_without_text_or_targets_without_sources():
    assert mixture.route({("a",): 10}, {"z": 1.0}, {"z": 2}) == {}
    assert mixture.route({}, {"a": 1.0}, {"a": 2}) == {}
    assert mixture.route({("a",): 10}, {"a": 0.5, "z": 0.5}, {"a": 1, "z": 1}) == {(("a",), "a"): 10}


@pytest.mark.skipif(not os.path.exists(tokens.RANKS), reason="no tokenizer files here")
def test_selection(spark):
    rows = [(i, f"text number {i} " + "word " * 20, "a" if i % 4 == 0 else "b") for i in range(400)]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, rows[1][1], "a"), (1003, rows[1][1], "b"), (1004, "other", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as copies", "2 as pattern")
    targets = spark.createDataFrame([("m", "a", 0.5, 2), ("m", "b", 0.5, 1), ("n", "a", 1.0, 1), ("n", "zero", 0.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    chosen = mixture.mix_sources(docs, targets).cache()
    assert chosen.groupBy("mix_name", "source", "doc_id").count().filter("count > 1").count() == 0
    for r in mixture.actual_shares(chosen, targets).collect():
        assert abs(r.actual_share - r.target_share) < 0.005 and r.most_copies <= r.max_repeats
    whole = chosen.filter("mix_name = 'n'").count()
    assert whole == 101
    assert mixture.mix_sources(docs.limit(0), targets).count() == 0
    again = mixture.mix_sources(docs.repartition(3), targets)
    assert chosen.exceptAll(again).count() == 0 and again.exceptAll(chosen).count() == 0


@pytest.mark.skipif(not os.path.exists(tokens.RANKS), reason="no tokenizer files here")
def test_settling_goes_on_until_no_text_helps(spark):
    rows = [(i, f"b{i}", "s", 2**i, 0, True, 2, 0) for i in range(12)] + [(99, "z", "t", 3, 0, False, 1, 0), (99, "z", "u", 3, 0, False, 1, 0)]
    schema = "doc_id int, h string, source string, n_tokens int, copies int, alone boolean, most int, uses long"
    chosen = spark.createDataFrame(rows, schema).selectExpr("'m' as mix_name", "source", "cast(h as binary) as text_hash", "doc_id", "n_tokens", "copies", "alone", "most", "uses")
    quotas = {("m", "s"): 682, ("m", "t"): 3, ("m", "u"): 3}
    got = mixture._settled(chosen, quotas, {k: 2 for k in quotas}).filter("copies > 0").collect()
    assert sum(r.n_tokens * r.copies for r in got if r.source == "s") == 682
    assert [(r.source, r.copies) for r in got if r.source != "s"] == [("t", 1)]
