from __future__ import annotations

import re
from collections import defaultdict

from lectern.llm import boilerplate
from lectern.llm.queries import p4_found
from lectern.sources.tables import table

BLOCKS = "document_id string, block_id string, page int, reading_order int, text string"


def test_lines_are_found_and_removed(spark):
    rows = []
    for i in range(6):
        rows.append((f"d{i}", "b1", 1, 0, f"© {i} Alle Rechte vorbehalten\nTeile das bitte mit\nEigener Satz nummer {'abcdef'[i]}"))
    rows += [rows[0], ("d0", "b2", None, None, None), ("d1", "b2", 1, 1, ""), ("d2", "b2", 1, 2, "zwei worte"), ("lost", "b1", 1, 0, "© Alle Rechte vorbehalten"), ("null", "b1", 1, 0, "© Alle Rechte vorbehalten")]
    df = spark.createDataFrame(rows, BLOCKS)
    sources = spark.createDataFrame([(f"d{i}", "s") for i in range(6)] + [("null", None)], "document_id string, source string")
    found, listed = boilerplate.boilerplate(df.selectExpr("*", "'x' as line", "1 as line_no"), sources)
    got = sorted((r.document_id, r.block_id, r.line_no) for r in found.collect())
    assert got == sorted((f"d{i}", "b1", n) for i in range(6) for n in (1, 2))
    assert len({r.component for r in found.collect()}) == 1
    assert [(r.source, r["lines"], r.documents, r.pieces) for r in listed.collect()] == [("s", 2, 6, 6)]
    texts = {(r.document_id, r.block_id): r.text for r in boilerplate.without_lines(df, found).collect()}
    assert texts["d3", "b1"] == "Eigener Satz nummer d" and texts["d0", "b2"] is None and texts["d1", "b2"] == ""
    assert texts["lost", "b1"] == "© Alle Rechte vorbehalten"


def test_empty_tables(spark):
    none = spark.createDataFrame([], BLOCKS)
    sources = spark.createDataFrame([], "document_id string, source string")
    assert boilerplate.boilerplate(none, sources)[0].count() == 0


def test_edges_make_blocks(spark):
    """Two lines that always follow each other are one block; a third that stands elsewhere is its own; without edges there would be three."""
    rows = [(f"d{i}", "b", 1, 0, "eins zwei drei\nvier fünf sechs") for i in range(6)] + [(f"d{i}", "c", 2, 1, "sieben acht neun") for i in range(6)]
    rows += [("d0", "x", 3, 2, "vier fünf sechs\nsieben acht neun")]
    found, listed = boilerplate.boilerplate(spark.createDataFrame(rows, BLOCKS), spark.createDataFrame([(f"d{i}", "s") for i in range(6)], "document_id string, source string"))
    assert sorted((r["lines"], r.documents, r.pieces) for r in listed.collect()) == [(1, 6, 7), (2, 6, 7)]
    assert found.count() == 20 and len({r.component for r in found.collect()}) == 2


def test_many_lines_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(boilerplate, "BROADCAST_LINES", -1)
    df = spark.createDataFrame([(f"d{i}", "b", 1, 0, "eins zwei drei") for i in range(4)], BLOCKS)
    sources = spark.createDataFrame([(f"d{i}", "s") for i in range(4)], "document_id string, source string")
    assert boilerplate.boilerplate(df, sources)[0].count() == 4


def test_against_brute_force(spark, folder):
    about = {}
    for r in table(spark, folder, "normalized_documents").orderBy("ingested_at").collect():
        about[r.document_id] = (r.source_relative_path.split("/")[0], r.classification)
    size, where, lines = defaultdict(set), defaultdict(set), defaultdict(set)
    for d, (s, c) in about.items():
        if c != "likely_scanned":
            size[s].add(d)
    for r in table(spark, folder, "blocks").collect():
        s, c = about[r.document_id]
        if r.text is None or c == "likely_scanned" or r.block_type in ("title", "heading"):
            continue
        for n, line in enumerate(r.text.split("\n"), 1):
            runs = tuple(re.findall(r"[^\W\d_]+", line.lower()))
            if len(runs) >= 3:
                where[s, runs].add(r.document_id)
                lines[s, runs].add((r.document_id, r.block_id, n))
    true = {x for k, v in lines.items() if len(where[k]) >= 3 and 20 * len(where[k]) >= len(size[k[0]]) for x in v}
    got = {tuple(r) for r in p4_found(spark, folder).select("document_id", "block_id", "line_no").collect()}
    assert got == true and true
