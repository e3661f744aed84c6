from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern import session
from lectern.functions import text as X
from lectern.functions.labels import clean_path, language_code, source_of
from lectern.operators import association, cleaning, inventory, matching, multisets, ordering, progress, quality, selection, structure


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


def test_text_functions(spark):
    assert one(spark, X.normalize_text, " a  b\r\nc\n \n\n d \r") == "a b c\n\nd"
    assert one(spark, X.normalize_text, None) is None and one(spark, X.normalize_text, "") == ""
    assert one(spark, X.clean_block, "carci-\nnome  a b\n• x") == "carcinome a b\n- x"
    assert one(spark, X.clean_block, "zeile\neins") == "zeile eins"
    assert one(spark, X.key_text, " Straße\tA ") == "strasse a"
    assert one(spark, lambda c: X.leading(c, 5), "abc def") == "abc" and one(spark, lambda c: X.leading(c, 3), "abcdef") == "abc" and one(spark, lambda c: X.leading(c, 9), "ab") == "ab"
    assert one(spark, lambda c: X.trailing(c, 5), "abc def") == "def" and one(spark, lambda c: X.trailing(c, 0), "abc") is None and one(spark, lambda c: X.trailing(c, 3), "abcdef") == "def"
    assert one(spark, X.measured, "5mg et 2,5 ml/j, 7 chats, 50 %") == ["5 mg", "2,5 ml", "50 %"]
    assert one(spark, X.numbers, "G1 2,5 1.5x .7") == ["2,5", "1", "7"] and one(spark, X.words, "L'e\u0301té; 2x") == ["l'été", "2x"]
    assert one(spark, X.signed_numbers, "-5 3-5 >5 5 % 7‰ G1 a+2 (±3,5)") == ["-5", "3", "5", ">5", "5 %", "7‰", "2", "±3,5"]
    assert one(spark, X.units, "5 mg, MMHG; 3 cmx") == ["mg", "mmhg"] and one(spark, X.text_hash, "e\u0301te\u0301") == one(spark, X.text_hash, "été")
    assert one(spark, X.key_text, "ﬂOTO\u00a0 É") == "floto é" == one(spark, X.key_text, "ﬂoto E\u0301")
    assert [one(spark, lambda c: X.metadata_class(c, F.lit(3)), t) for t in ("Dr Nadia", "Université X", "2019 - 2020", "Ein Titel", "Ein Satz.")] == ["teacher_name", "institution", "academic_year", "course_title", "body_content"]
    assert one(spark, X.claim_words, "Les deux reins et LES reins") == ["deux", "reins"]
    assert one(spark, X.single_letter_ratio, "") == 1.0 and one(spark, X.alpha_ratio, "") == 0.0 and one(spark, X.symbol_ratio, "a+") == 0.5
    assert one(spark, X.script, "طب du") == "fr+ar" and one(spark, X.script, "1") == "fr"
    assert one(spark, X.is_heading, "1. Introduction") and one(spark, X.is_heading, "INTRODUCTION") and not one(spark, X.is_heading, "Une phrase.")
    assert [one(spark, X.token_estimate, n, "int") for n in (0, 1, 4, 5)] == [0, 1, 1, 2]
    two = spark.createDataFrame([(["a"], ["a", "b"]), ([], [])], "a array<string>, b array<string>").select(X.jaccard(F.col("a"), F.col("b")).alias("j"), X.contained(F.col("a"), F.col("b")).alias("c")).collect()
    assert [(r.j, r.c) for r in two] == [(0.5, 1.0), (1.0, 0.0)]
    folders = spark.createDataFrame([(["a", "b"], ["a", "bb"]), (["a"], ["a", "b"]), ([""], ["x"])], "a array<string>, b array<string>")
    assert [r.r for r in folders.select(X.shared_folders(F.col("a"), F.col("b")).alias("r")).collect()] == ["a", "a", ""]
    ids = spark.createDataFrame([("a", None), ("a", ""), ("", "a")], "a string, b string").select(X.identity(F.col("a"), F.col("b")).alias("i")).collect()
    assert len({r.i for r in ids}) == 3


def test_labels(spark):
    for label, code in (("fr-FR", "fr"), ("FRENCH", "fr"), ("deu", "de"), (" es ", "es"), ("fr+ar", "fr+ar"), (None, "und"), ("", "und"), ("und", "und"), ("it_IT", "it"), ("??", "und")):
        assert one(spark, language_code, label) == code
    for path in ("a-b/c.pdf", "./A-B/c.pdf", "/a-b//c.pdf", "a%2Db\\c.pdf", "a-b /c.pdf"):
        assert one(spark, clean_path, path) == "a-b/c.pdf" and one(spark, source_of, path) == "a-b"
    assert one(spark, source_of, None) is None and one(spark, source_of, "100%") == "100%"


def rows_in_order(spark, n=200, seed=1):
    r = random.Random(seed)
    return [(r.choice(["a", "b", None]), r.choice([None, 1, 2, 3]), i, r.choice(["x", "y", None]), r.choice([None, 1, 2])) for i in range(n)]


def test_ordering(spark, monkeypatch):
    monkeypatch.setattr(ordering, "STRETCH", 7)
    rows = rows_in_order(spark)
    df = spark.createDataFrame(rows, "g string, page int, i int, k string, v int")
    n = ordering.number(df, ["g"], ["page"], ["i"]).cache()
    groups = {}
    for row in sorted(rows, key=lambda x: (str(x[0]), x[1] is not None, x[1] or 0, x[2])):
        groups.setdefault(row[0], []).append(row)
    assert {(r.g, r.i): r.ordinal for r in n.collect()} == {(g, x[2]): k for g, xs in groups.items() for k, x in enumerate(xs, 1)}
    back = {(r.g, r.i): r.b for r in ordering.neighbour(n, ["g"], "ordinal", {"i": "b"}, -2).collect()}
    assert back == {(g, x[2]): (xs[k - 2][2] if k >= 2 else None) for g, xs in groups.items() for k, x in enumerate(xs)}
    run = {(r.g, r.i): (r.s, r.b) for r in ordering.running(ordering.running(n, ["g"], "ordinal", F.col("v"), "s"), ["g"], "ordinal", F.col("v"), "b", whole=False).collect()}
    assert run == {(g, x[2]): (sum(y[4] or 0 for y in xs[: k + 1]), sum(y[4] or 0 for y in xs[:k])) for g, xs in groups.items() for k, x in enumerate(xs)}
    island = {(r.g, r.i): r.run for r in ordering.islands(n, ["g"], "ordinal", ["k"]).collect()}
    for g, xs in groups.items():
        number = 0
        for k, x in enumerate(xs):
            number += k == 0 or x[3] != xs[k - 1][3]
            assert island[g, x[2]] == number
    none = n.limit(0)
    assert ordering.islands(none, ["g"], "ordinal", ["k"]).count() == ordering.number(df.limit(0), ["g"], ["page"], ["i"]).count() == 0


def test_packing_and_budgets(spark):
    sizes = [120, 120, 10, None, 300, 40]
    df = spark.createDataFrame([("d", i, n) for i, n in enumerate(sizes)] + [(None, 0, 5)], "g string, i int, n int")
    got = {(r.g, r.i): r.pack for r in structure.pack(df, ["g"], ["i"], "n", structure.Limits(150, 200, 30, 0)).collect()}
    assert got == {("d", 0): 0, ("d", 1): 1, ("d", 2): 1, ("d", 3): 1, ("d", 4): 2, ("d", 5): 3, (None, 0): 0}
    assert structure.pack(df.limit(0), ["g"], ["i"], "n", structure.Limits()).count() == 0
    with pytest.raises(ValueError):
        structure.Limits(soft=10, least=20)
    rows = [("d", 1, 60, "h1"), ("d", 2, 60, "h1"), ("d", 3, 50, "h2"), ("d", 4, 40, "h2"), ("d", 5, 0, "h3"), ("d", 6, 0, "h4")]
    picks = selection.budgeted(spark.createDataFrame(rows, "g string, i int, n int, h string"), ["g"], ["i"], "n", "h", 3, 100)
    assert [r.reason for r in picks.orderBy("i").collect()] == ["selected", "duplicate", "over_budget", "selected", "selected", "enough_items"]
    tight = selection.budgeted(spark.createDataFrame(rows, "g string, i int, n int, h string"), ["g"], ["i"], "n", "h", 3, 100, tokens=20)
    assert [r.reason for r in tight.orderBy("i").collect()] == ["selected", "duplicate", "over_budget", "over_budget", "selected", "selected"]
    assert selection.short_groups(tight, ["g"], 3).count() == 0 and [r.selected for r in selection.short_groups(tight, ["g"], 4).collect()] == [3]
    parts = spark.createDataFrame([("d", i, a, n) for i, (a, n) in enumerate([(True, 5), (True, 5), (True, 9), (False, 1), (None, 1)])], "g string, i int, a boolean, n int")
    assert [r.section for r in structure.merged_segments(parts, ["g"], "i", "a", "n", 10).orderBy("i").collect()] == [0, 0, 1, 2, 3]


def split_brute(text, most):
    """Sentences and lines packed; a longer sentence by words, apart from the others."""
    out, now = [], ""
    for s in [x for x in re.split(r"(?<=[.!?])\s+|\n+", text.strip(" ")) if x]:
        if len(s) > most:
            if now:
                out.append(now)
                now = ""
            group = ""
            for w in s.split(" "):
                if group and len(f"{group} {w}".strip(" ")) > most:
                    out.append(group)
                    group = w
                else:
                    group = f"{group} {w}".strip(" ")
            if group:
                out.append(group)
        elif now and len(f"{now} {s}") > most:
            out.append(now)
            now = s
        else:
            now = f"{now} {s}".strip(" ")
    return out + ([now] if now else [])


def test_split_paragraph(spark):
    r = random.Random(2)
    texts = ["".join(r.choice(["mot ", "long-mot ", "fin. ", "quoi? ", "a\n", "x" * 30 + " "]) for _ in range(r.randrange(40))) for _ in range(40)] + ["", None, "x" * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {}
    for row in structure.split_paragraph(df, "text", 24).collect():
        got.setdefault(row.i, []).append((row.fragment_no, row.fragment))
    assert {i: [t for _, t in sorted(v)] for i, v in got.items()} == {i: b for i, t in enumerate(texts) if t and (b := split_brute(t, 24))}


def test_cleaning(spark):
    rows = [
        ("d", "a1", 1, 0, "CamScanner"), ("d", "a2", 1, 1, "Dr Nadia Zelm"), ("d", "a3", 1, 2, "TITLE: Nieren\u00a0heute"), ("d", "a4", 1, 3, "Ein carci-\nnome wächst."), ("d", "a5", 1, 4, "ein  carcinome wächst."),
        ("d", "b1", 2, 0, "dr nadia zelm"), ("d", "b2", 2, 1, "alpha | beta | gamma | delta"), ("d", "b3", 2, 2, "Delta gamma beta alpha"), ("d", "b4", 2, 3, "alpha | beta"), ("d", "b5", 2, 4, "Delta gamma beta alpha"), ("d", "b6", 2, 5, "delta gamma beta alpha"), ("d", "b7", 2, 6, None),
    ]
    raw = spark.createDataFrame(rows, "document_id string, block_id string, page int, place int, text string").selectExpr("*", "1 as ordinal", "'x' as key")
    c = cleaning.clean_pages(raw)
    got = {r.block_id: (r.text, r.classification, r.retained, r.reason) for r in c.collect()}
    assert got == {
        "a1": ("", "body_content", True, None), "a2": ("Dr Nadia Zelm", "teacher_name", True, None), "a3": ("Nieren heute", "course_title", True, None), "a4": ("Ein carcinome wächst.", "body_content", True, None), "a5": ("ein carcinome wächst.", "body_content", False, "repeats the block before"),
        "b1": ("dr nadia zelm", "repeated_header", False, "repeated header"), "b2": ("alpha | beta | gamma | delta", "course_title", True, None), "b3": ("Delta gamma beta alpha", "course_title", False, "repeats a table"), "b4": ("alpha | beta", "course_title", True, None),
        "b5": ("Delta gamma beta alpha", "course_title", True, None), "b6": ("delta gamma beta alpha", "course_title", False, "repeats the block before"), "b7": ("", "body_content", True, None),
    }
    assert {r.transformation for r in c.filter("block_id in ('a4')").collect()} == {"split_word_repair"} and c.filter("block_id = 'a1' and transformation = 'metadata_classification'").count() == 1
    assert cleaning.clean_texts(c).first().text.startswith("[Page 1]\n\nDr Nadia Zelm\n\nNieren heute")
    assert "===== SLIDE 2 =====" in cleaning.clean_texts(c, spark.createDataFrame([("d", "slide")], "document_id string, location_type string"), "keep").first().text
    assert "Page" not in cleaning.clean_texts(c, mode="remove").first().text and cleaning.clean_pages(raw.limit(0)).count() == 0
    assert one(spark, structure.render_table, "a|b\n\nc") == "a | b\nc | "


def placed(spark, objects, chunks, members, holders=()):
    """Objects: id, asset?, block, page, top, caption; chunks: id, first, last page; members: chunk, index, block, top, key."""
    df = lambda rows, columns: spark.createDataFrame([("d", *r) for r in rows], "document_id string, " + columns)
    got = association.associate(
        df(objects, "object_id string, is_asset boolean, block_id string, page int, top double, caption string"), df(holders, "object_id string, block_id string"),
        df(chunks, "chunk_id string, first_page int, last_page int"), df(members, "chunk_id string, chunk_index int, block_id string, top double, key string"),
    )
    return {r.object_id: (r.chunk_id, r.method) for r in got.collect()}


def test_association(spark):
    objects = [("t1", False, "b1", 1, 10.0, None), ("t2", False, "zz", 2, 10.0, None), ("t3", False, "zz", 3, 10.0, None), ("t4", False, "zz", 4, 1.0, "bild 1"), ("t5", False, "zz", None, None, "x"), ("a1", True, "f1", 3, 480.0, None), ("a2", True, "f2", 3, 30.0, None), ("a3", True, "f3", 3, None, None), ("a4", True, "f4", 1, 5.0, None)]
    chunks = [("c1", 1, 1), ("c2", 2, 2), ("c3", 3, 3), ("c4", 3, 3), ("c5", 4, 4), ("c6", 4, 4), ("c7", None, None)]
    members = [("c1", 0, "b1", 0.0, "x"), ("c2", 1, "b1", 0.0, None), ("c3", 2, "m", 10.0, None), ("c3", 2, "n", 500.0, None), ("c4", 3, "o", 440.0, None), ("c4", 3, "p", 50.0, None), ("c5", 4, "q", None, "bild 1 zeigt"), ("c6", 5, "r", None, "bild 1"), ("c2", 1, "f4", None, None)]
    assert placed(spark, objects, chunks, members, [("a4", "f4")]) == {
        "t1": ("c2", "explicit_block_reference"), "t2": ("c2", "unique_same_location"), "t3": (None, None), "t4": ("c6", "caption_relationship"), "t5": (None, None), "a1": ("c3", "spatial_nearest"), "a2": (None, None), "a3": (None, None), "a4": ("c2", "explicit_block_reference"),
    }
    assert placed(spark, [("o", True, "x", 300, 10.0, None)], [("long", 1, 500), ("short", 299, 299)], []) == {"o": ("long", "unique_same_location")}
    assert placed(spark, [], chunks, members) == {}


def test_similar_sets_against_all_pairs(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(14)]
    base = [sorted(r.sample(words, 9)) for _ in range(6)]
    rows = []
    for i in range(90):
        s = set(r.choice(base))
        if r.random() < 0.6:
            s ^= {r.choice(words)}
        rows.append((r.choice(["g", "h", None]), f"k{i:02}", sorted(s)))
    rows += [("g", "e1", []), ("g", "e2", None)]
    got = {(x.g, x.left_key, x.right_key) for x in selection.similar_sets(spark.createDataFrame(rows, "g string, k string, t array<string>"), "g", "k", "t", 0.8).collect()}
    first, true = {}, set()
    for g, k, t in sorted(rows, key=lambda x: x[1]):
        if g and t:
            head = first.setdefault((g, tuple(t)), k)
            if head != k:
                true.add((g, head, k))
    heads = list(first.items())
    for i, ((g, a), ka) in enumerate(heads):
        for (h, b), kb in heads[i + 1 :]:
            if g == h and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.8:
                true.add((g, *sorted((ka, kb))))
    assert got == true and true


def test_similar_sets_broadcasts_only_what_is_counted(spark, monkeypatch, tmp_path):
    r = random.Random(5)
    base = [r.sample(range(400), 40) for _ in range(5)]
    rows = [("g", f"k{i:03}", [f"w{x}" for x in sorted({*r.choice(base), *r.sample(range(400), i % 7)})]) for i in range(150)]
    rows += [("h", "k000", rows[0][2]), ("h", "k001", [f"u{x}" for x in range(30)]), ("h", "k002", None), (None, "k003", rows[0][2])]
    spark.createDataFrame(rows, "g string, k string, t array<string>").write.parquet(f"{tmp_path}/sets.parquet")
    df, plans, cut = spark.read.parquet(f"{tmp_path}/sets.parquet"), [], session.cut_lineage
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(selection, "cut_lineage", lambda x: (plans.append(plan(x)), cut(x))[1], raising=False)
    found = []
    for most in (1_000, 0):
        monkeypatch.setattr(selection, "SETS", most, raising=False)
        plans.clear()
        out = selection.similar_sets(df, "g", "k", "t", 0.85)
        found.append(sorted(map(tuple, out.collect())))
        plans.append(plan(out))
    assert not any("Broadcast" in x for x in plans)
    heads, true = {}, []
    for g, k, t in rows:
        if g and t and heads.setdefault((g, tuple(t)), k) != k:
            true.append((g, heads[g, tuple(t)], k, 1.0))
    for (g, a), ka in heads.items():
        true += [(g, ka, kb, round(s, 6)) for (h, b), kb in heads.items() if g == h and ka < kb and (s := len({*a} & {*b}) / len({*a} | {*b})) >= 0.85]
    assert found == [sorted(true)] * 2 and {x[3] < 1 for x in true} == {True, False}


def test_inventory(spark):
    df = spark.createDataFrame([("a/x.pdf", "h1", 5), ("a/x.pptx", "h2", 9), ("b/y.PDF", "h1", None), ("c", None, 1)], "path string, hash string, size int").selectExpr("*", "1 as _there", "2 as copies")
    assert {(r.name, r.copies, r.first_name) for r in inventory.duplicates(df.withColumnRenamed("path", "name").drop("copies"), "hash", "name").collect()} == {("a/x.pdf", 2, "a/x.pdf"), ("b/y.PDF", 2, "a/x.pdf")}
    assert [r.path for r in inventory.included(df, "path", "size", ["pdf", "pptx"], ["*.pptx"], 10).collect()] == ["a/x.pdf"]
    assert {r.path: r.target for r in inventory.target_paths(df, "path", "hash").collect()} == {"a/x.pdf": "a/x__pdf.txt", "a/x.pptx": "a/x__pptx.txt", "b/y.PDF": "b/y.txt", "c": "c.txt"}
    old = spark.createDataFrame([("a/x.pdf", "h1"), ("a/x.pptx", "old"), ("gone", None)], "path string, hash string")
    assert {r.path: r.state for r in inventory.reuse(df, old, "path", ["hash"]).collect()} == {"a/x.pdf": "current", "a/x.pptx": "stale", "b/y.PDF": "new", "c": "new"}
    assert {r.path: r.change for r in inventory.changes(old, df, "path", "hash").collect()} == {"a/x.pptx": "modified", "gone": "removed", "b/y.PDF": "added", "c": "added"}
    pages = spark.createDataFrame([("d", 1, 100, 110), ("e", 1, 100, 80), ("f", 1, None, 5), ("g", 1, 10, 500), ("h", 1, 100, 300), ("h", 2, 10, 30)], "document_id string, page int, before int, after int")
    assert {r.document_id: (r.outcome, r.gain) for r in inventory.scan_metrics(pages).collect()} == {"d": ("no_material_improvement", 10.0), "e": ("degraded", -20.0), "f": ("invalid", None), "g": ("accepted", 4900.0), "h": ("accepted_with_warnings", 200.0)}


def test_multisets_and_quality(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"], ["a"]), (2, None, ["x"]), (3, ["z"], None)], "i int, l array<string>, r array<string>")
    assert {(x.i, x.v, x.surplus) for x in multisets.difference(df, ["i"], F.col("l"), F.col("r"), "v").collect()} == {(1, "a", 1), (1, "b", 1), (3, "z", 1)}
    whole = "Une page entière. " * 30
    rows = [("d", 1, "CamScanner\n\nFigure 1", "", ["CamScanner", "Figure 1"], 0), ("d", 2, None, None, [], None), ("d", 3, whole, whole, [whole], 0), ("e", 1, "# @ + $ % ~ = < > | a 1", "# @ + $ % ~ = < > | a 1", ["x"], 0), ("f", 1, whole + "10  8 BK", whole, [whole], 1), ("f", 2, whole, whole, ["IVEinleitung und so weiter", "dies ist ein langer Block ohne Ende", "und so weiter geht es hier noch", "bis zum Schluss"], 0), ("f", 3, "EIN TITEL DER SEITE HIER", "EIN TITEL DER SEITE HIER", ["t"], 0)]
    pages = spark.createDataFrame(rows, "document_id string, page int, raw string, cleaned string, blocks array<string>, burden int")
    got = {(r.document_id, r.page): (r.status, r.reasons) for r in quality.readiness(pages).collect()}
    assert got == {
        ("d", 1): ("image_dependent", "caption_without_recoverable_visual_content,scanner_watermark,sparse_or_empty_location"), ("d", 2): ("unusable", "sparse_or_empty_location"), ("d", 3): ("ready", ""), ("e", 1): ("unusable", "probable_ocr_gibberish,sparse_location"),
        ("f", 1): ("ready_with_noise", "ambiguous_numerical_notation,duplicate_extraction_burden"), ("f", 2): ("ready_with_noise", "broken_sentence_fragments,malformed_heading"), ("f", 3): ("ready", "title_only_location"),
    }
    whole = {r.document_id: r.status for r in quality.document_readiness(quality.readiness(pages)).collect()}
    assert whole == {"d": "partially_reconstructable", "e": "unusable", "f": "ready_with_noise"}
    gaps = spark.createDataFrame([("d", 0), ("d", 2), ("e", 0), ("e", 1), ("f", None)], "document_id string, i int")
    assert sorted(r.document_id for r in quality.numbering_gaps(gaps, "document_id", "i", "gap").collect()) == ["d", "f"]


def test_matching(spark):
    raw = spark.createDataFrame([("d", 1, "r1", "Der Patient erhält morgens zehn Milligramm und kommt wieder"), ("d", 1, "r2", "Ein ganz anderer Satz über Wetter"), ("d", 2, "r3", "nur hier"), ("d", 1, "r4", None), ("d", 3, "r5", "gleich gleich"), ("d", 3, "r6", "gleich gleich!")], "document_id string, page int, raw_block_id string, text string")
    blocks = spark.createDataFrame([("d", 1, "b1", "Der Paticnt erhält morgens zehn Milligramm und kommt wieder"), ("d", 1, "b2", "Etwas Drittes"), ("d", 2, "b3", " "), ("d", None, "b4", "nur hier"), ("d", 3, "b5", "gleich gleich")], "document_id string, page int, block_id string, text string")
    assert {(r.block_id, r.raw_block_id) for r in matching.match_raw(blocks, raw).collect()} == {("b1", "r1")}
    assert {r.raw_block_id for r in matching.pages_without_text(raw, blocks).collect()} == {"r3"}
    refs = spark.createDataFrame([("d", "c", 0, "x"), ("d", "c", 1, "z"), ("d", "c", 2, "y"), ("d", "c", 3, "?"), ("d", "e", 0, "x"), ("d", "e", 1, "w")], "document_id string, chunk_id string, at int, block_id string")
    order = spark.createDataFrame([("d", b, i) for i, b in enumerate("xyzw", 1)], "document_id string, block_id string, ordinal int")
    got = {r.chunk_id: (r.references, r.unknown, r.reordered, r.gaps) for r in matching.reference_order(refs, order).collect()}
    assert got == {"c": (4, 1, 1, 0), "e": (2, 0, 0, 2)}


def test_progress_ladders(spark):
    ladder = {"a": ["reconstructed", "needs_human_review"], "b": ["unchanged_clean"], "c": ["unchanged_clean"], "d": ["model_failure", "reconstructed"], "e": ["unusable", "image_dependent"], "f": ["unusable"], "g": ["reconstructed", "image_dependent"], "h": ["reconstructed", "unchanged_clean"], "k": ["model_unavailable"]}
    parts = spark.createDataFrame([(d, s) for d, ss in ladder.items() for s in ss], "document_id string, status string")
    ready = spark.createDataFrame([(d, "partially_reconstructable" if d == "c" else "human_review_required" if d == "j" else "ready") for d in "abcdefghijk"], "document_id string, readiness string")
    got = {r.document_id: r.status for r in progress.reconstruction_status(parts, ready).collect()}
    assert got == {
        "a": "needs_human_review", "b": "unchanged_clean", "c": "partially_reconstructable", "d": "model_failure", "e": "image_dependent", "f": "unusable", "g": "reconstructed_with_warnings", "h": "reconstructed", "i": "unusable", "j": "needs_human_review", "k": "model_unavailable",
    }
    df = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    reached = {r.id: (r.stage, r.complete) for r in progress.furthest(df("a", "b", "c", "c"), {"one": df("a", "b", "b"), "two": df("a", "c")}, "id").collect()}
    assert reached == {"a": ("two", True), "b": ("one", False), "c": ("source", False)}
    manifest = spark.createDataFrame([("a", "h", "exported"), ("b", "h", "failed"), ("c", "x", "exported")], "path string, sha256 string, status string")
    found = progress.discovered(spark.createDataFrame([(p, "h") for p in "abcd"], "path string, sha256 string"), manifest)
    assert {r.path: r.state for r in found.collect()} == {"a": "ok", "b": "not_successful", "c": "hash_differs", "d": "not_in_manifest"}


def test_number_moves_rows_once(spark):
    """One exchange of the rows; the totals' are small and of their own columns."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    df = spark.range(50).selectExpr("cast(id % 3 as string) g", "cast(id % 7 as int) page", "id", "'x' as text")
    plans = []
    for made in (ordering.number(df, ["g"], ["page"], ["id"]), ordering.islands(df.withColumn("n", F.col("id")), ["g"], "n", ["page"])):
        plans.append(made._jdf.queryExecution().executedPlan().toString())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [sum("text" in line for line in p.split("\n") if "Exchange" in line) for p in plans]
    assert [p.count("Exchange") for p in plans][0] <= 4 and moved == [0, 0]
