"""Cases that a cut of the input or of the rule would lose."""

from __future__ import annotations

from datetime import datetime

from lectern.operators import building, matching, structure
from lectern.plans import inventories, structures

_ABOUT = "document_id string, source_relative_path string, source_extension string, document_type string, title string, language string, page_or_slide_count int, classification string, config_id string, parser_name string, ingested_at timestamp"


def test_snapshot_diff_sees_every_document(spark, tmp_path):
    rows = [(i, f"{i}.pdf", ".pdf", None, None, None, 1, kind, config, None, datetime(2026, 1, 1)) for i, kind, config in (("a", "native_text", "cfg-quiz"), ("b", "likely_scanned", "cfg-quiz"), ("c", "native_text", None), ("d", "native_text", "cfg-base"))]
    spark.createDataFrame(rows, _ABOUT).write.parquet(f"{tmp_path}/normalized_documents.parquet")
    spark.createDataFrame([(f"{i}.pdf", "ready") for i in ("a", "b", "e")], "source_relative_path string, readiness_status string").write.parquet(f"{tmp_path}/cleaning_sidecars.parquet")
    got = {(r.source_relative_path, r.change) for r in inventories.snapshot_diff(spark, str(tmp_path)).collect()}
    assert got == {("b.pdf", "modified"), ("c.pdf", "added"), ("d.pdf", "added"), ("e.pdf", "removed")}


def test_the_nearest_chunk_is_judged_by_all_its_blocks(spark, tmp_path):
    at = datetime(2026, 1, 1)
    blocks = [("a", 10.0, None, None), ("b", 90.0, None, None), ("c", 60.0, None, None), ("f", 95.0, None, "asset"), ("t", 95.0, "table", None)]
    rows = [("d", i, "figure" if asset else "table" if tab else "paragraph", i, 1, n, None, "page", top, tab, asset, at) for n, (i, top, tab, asset) in enumerate(blocks)]
    spark.createDataFrame(rows, "document_id string, block_id string, block_type string, text string, page int, reading_order int, section_id string, location_type string, bbox_top double, table_id string, asset_id string, ingested_at timestamp").write.parquet(f"{tmp_path}/blocks.parquet")
    chunks = [("d", "wide", 0, "x", [("a", None, 1), ("b", None, 1)], at), ("d", "low", 1, "y", [("c", None, 1)], at)]
    spark.createDataFrame(chunks, "document_id string, chunk_id string, chunk_index bigint, text string, refs array<struct<block_id: string, excerpt: string, page: int>>, generated_at timestamp").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {r.object_id: (r.chunk_id, r.method) for r in structures.association_cascade(spark, str(tmp_path)).collect()}
    assert got == {"asset": ("wide", "spatial_nearest"), "table": (None, None)}


def test_chunks_are_built_of_atoms_runs_and_packs(spark):
    limits = structure.Limits(soft=40, hard=60, least=10)
    blocks = [
        ("title", "Titel"), ("paragraph", "a" * 30), ("paragraph", "b" * 9),
        ("heading", "Kopf"), ("table", "x | y"), ("caption", "Tafel 1"), ("paragraph", "kurz"), ("list_item", "eins"), ("list_item", "zwei"), ("caption", "Bild"), ("figure", None), ("paragraph", "Satz eins ist hier lang. " * 4), ("paragraph", "c" * 28), ("paragraph", "d" * 35), ("paragraph", "e"),
    ]
    rows = [("d", f"b{n:02}", kind, n, 1, None, "page", text is not None) for n, (kind, text) in enumerate(blocks)]
    ordered = structure.reading_order(spark.createDataFrame(rows, "document_id string, block_id string, block_type string, reading_order int, page int, section_id string, location_type string, has_text boolean"))
    texts = spark.createDataFrame([("d", f"b{n:02}", text) for n, (_, text) in enumerate(blocks)], "document_id string, block_id string, text string")
    levels = spark.createDataFrame([], "document_id string, section_id string, level int, path array<string>")
    got = building.build(ordered, spark.createDataFrame([("d", "b00")], "document_id string, block_id string"), texts, levels, limits).orderBy("chunk_index").collect()
    assert [(r.chunk_type, [int(b[1:]) for b in r.blocks]) for r in got] == [
        ("document_preamble", [0, 1]), ("paragraph_group", [2]), ("table_context", [3, 4, 5, 6]), ("list", [7, 8]), ("figure_context", [9, 10]), ("paragraph_group", [11]), ("paragraph_group", [11]), ("paragraph_group", [12]), ("paragraph_group", [13, 14]),
    ]
    assert [r.chunk_index for r in got] == list(range(9)) and len({r.chunk_id for r in got}) == 9
    assert all(len(r.text) <= limits.hard for r in got) and got[2].text == "Kopf\n\nx | y\n\nTafel 1\n\nkurz"
    assert all(not r.warnings and r.confidence == "weak" and r.location_type == "page" for r in got)


def test_what_can_not_be_cut_is_kept_and_warned_of(spark):
    limits = structure.Limits(soft=40, hard=60, least=10)
    rows = [("d", "t", "table", 0, 1, "s", "page", True), ("d", "p", "paragraph", 1, 1, "s", "page", True)]
    ordered = structure.reading_order(spark.createDataFrame(rows, "document_id string, block_id string, block_type string, reading_order int, page int, section_id string, location_type string, has_text boolean"))
    texts = spark.createDataFrame([("d", "t", "x" * 300), ("d", "p", "kurz")], "document_id string, block_id string, text string")
    sections = spark.createDataFrame([("d", "s", 2, ["A", "B"])], "document_id string, section_id string, level int, path array<string>")
    got = building.build(ordered, spark.createDataFrame([("d", "t")], "document_id string, block_id string"), texts, sections, limits).orderBy("chunk_index").collect()
    assert [(r.chunk_type, list(r.warnings), list(r.path), r.confidence) for r in got] == [("table_context", ["atomic_oversize"], ["A", "B"], "canonical"), ("paragraph_group", [], ["A", "B"], "canonical")]


def test_plain_and_list_atoms_are_packed_apart():
    limits = structure.Limits(soft=20, hard=25, least=5)
    atom = lambda n, forced=None: {"rows": [], "forced": forced, "text": "x" * n, "fragment": None}
    sizes = lambda *atoms: [([len(a["text"]) for a in p], f) for p, f, _ in building.packs_of(iter(atoms), limits)]
    assert sizes(atom(4), atom(20), atom(9), atom(9), atom(1)) == [([4], None), ([20], None), ([9, 9], None), ([1], None)]
    assert sizes(atom(20), atom(4), atom(18)) == [([20], None), ([4, 18], None)]
    assert sizes(atom(9), atom(9), atom(9), atom(2, "list"), atom(3)) == [([9, 9], None), ([9], None), ([2], "list"), ([3], None)]
    assert sizes(atom(3, "list"), atom(9)) == [([3, 9], None)]


def test_blocks_of_misread_words_match(spark):
    words = "pancreatite cholestase insuffisance medicament radiographie hypertension".split()
    noisy = " ".join(w[:4] + "#" + w[5:] for w in words)
    raw = spark.createDataFrame([("d", 1, "r1", " ".join(words)), ("d", 2, "r2", "ohnezwischenraum" * 4)], "document_id string, page int, raw_block_id string, text string")
    blocks = spark.createDataFrame([("d", 1, "b1", noisy), ("d", 2, "b2", "ohnezwischenraum" * 3 + "ohnezwischenraom")], "document_id string, page int, block_id string, text string")
    assert {(r.block_id, r.raw_block_id) for r in matching.match_raw(blocks, raw).collect()} == {("b1", "r1"), ("b2", "r2")}
