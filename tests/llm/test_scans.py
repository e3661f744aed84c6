from __future__ import annotations

import numpy as np

from lectern.llm import scans

ITEMS = "document_id string, item_id string, page int, place int, text string"
WORDS = "pourquoi patient malade semaine contrôle traitement"


def run(spark, items):
    df = spark.createDataFrame(items, ITEMS)
    titles = spark.createDataFrame([("d", "Cours sur la zelmiome"), ("n", None)], "document_id string, title string")
    clean = spark.createDataFrame([(WORDS,)] * 8, "text string")
    return scans.scan_text(df.selectExpr("*", "'x' as title", "1 as labels"), titles, clean)


def items():
    return [
        ("d", "i1", 1, 0, "Cours sur la zelmiome"), ("d", "i2", 1, 1, "le pati-\nent est un malade,\np0urquoi"), ("d", "i3", 1, 2, "- 1 -"),
        ("d", "i4", 2, 0, "COURS  SUR LA ZELMIOME · 2\nle contr¬\r\nôle dure une semaine –\nentière"), ("d", "i5", 2, 1, "61 %"), ("d", "i6", 2, 2, "texte sans fin\nPage 2 / 4"),
        ("d", "i7", 3, None, None), ("d", "i8", None, None, ""), ("d", "i9", 2, 3, "12 mg/L"), ("n", "i1", 3, 0, "iii"),
    ]


def test_each_noise_is_named(spark):
    got = {tuple(r) for r in run(spark, items()).noise().collect()}
    assert got == {("d", "i2", "split_word"), ("d", "i2", "misread_char"), ("d", "i3", "page_number"), ("d", "i4", "running_header"), ("d", "i4", "split_word"), ("d", "i6", "page_number"), ("n", "i1", "page_number")}


def test_paragraphs_are_continuous(spark):
    got = {(r.document_id, r.item_id): r.text for r in run(spark, items()).repaired().collect()}
    assert got["d", "i2"] == "le patient est un malade, pourquoi" and got["d", "i3"] == "" and got["d", "i4"] == "le contrôle dure une semaine – entière"
    assert ("d", "i7") not in got and got["d", "i8"] == ""


def test_paragraphs_go_over_items_and_pages(spark):
    items = [
        ("d", "i1", 1, 0, "Erster Absatz endet.\n\nDer zweite geht über\ndie Seite, weil er lang"), ("d", "i2", 1, 1, "- 1 -"), ("d", "i3", 2, 0, "Cours sur la zelmiome"),
        ("d", "i4", 2, 1, "ist und ein Wort bri-"), ("d", "i5", 2, 2, "cht."), ("d", "i6", 2, 3, "Dritter."), ("e", "i1", 1, 0, "fängt klein an"), ("e", "i2", None, None, "Ohne Seite"),
    ]
    got = [(r.document_id, r.paragraph_no, r.first_item, r["items"], r.page, r.last_page, r.text) for r in run(spark, items).paragraphs().orderBy("document_id", "paragraph_no").collect()]
    assert got == [
        ("d", 1, "i1", 1, 1, 1, "Erster Absatz endet."), ("d", 2, "i1", 3, 1, 2, "Der zweite geht über die Seite, weil er lang ist und ein Wort bricht."), ("d", 3, "i6", 1, 2, 2, "Dritter."),
        ("e", 1, "i2", 2, 1, 1, "Ohne Seite fängt klein an"),
    ]
    assert run(spark, []).paragraphs().count() == 0


def test_a_long_page_is_labelled_as_one_sequence(spark, monkeypatch):
    r = np.random.default_rng(3)
    kinds = ["Cours sur la zelmiome", "le pati-\nent va", "61 %", "- 2 -", "2", "iii", "Texte plein.", "Cours sur la zelmione", "x"]
    items = [("d", f"i{n:03}", 2, n, str(r.choice(kinds))) for n in range(200)]
    labels = []
    for segment in (64, 7, 1000):
        monkeypatch.setattr(scans, "SEGMENT", segment)
        monkeypatch.setattr(scans, "MARGIN", min(16, segment))
        found = run(spark, items).items.collect()
        labels.append(sorted((x.item_id, tuple(x.labels)) for x in found))
    assert len(labels[0]) == 200 and labels[0] == labels[1] == labels[2]


def test_a_word_without_end_makes_no_candidates(spark):
    words = spark.createDataFrame([("c" * 2_000_000,), ("paticnt",)], "word string")
    uses = spark.createDataFrame([("patient", 50)], "word string, uses bigint")
    assert [tuple(r) for r in scans.readings(words, uses).collect()] == [("paticnt", "patient")]


def test_empty_table_and_long_text(spark):
    assert run(spark, []).noise().count() == 0
    long = "\n".join(["le pati-", "ent"] * 20_000)
    assert [r.noise for r in run(spark, [("d", "x", 1, 0, long)]).noise().collect()] == ["split_word"]


def test_viterbi_against_all_paths():
    model = scans._model(scans.first_model())
    r = np.random.default_rng(1)
    rows = [r.integers(0, scans.SYMBOLS, n) for n in (0, 1, 3, 5, 4)]
    for seen, path in zip(rows, scans.viterbi(model, rows)):
        if not len(seen):
            assert len(path) == 0
            continue

        def score(p, seen=seen):
            return model.start[p[0]] + sum(model.emit[s, o] for s, o in zip(p, seen)) + sum(model.move[a, b] for a, b in zip(p, p[1:]))

        best = max(np.ndindex(*[4] * len(seen)), key=score)
        assert np.isclose(score(tuple(path)), score(best))


def test_words_are_counted(spark):
    df = spark.createDataFrame([("Été été l'an deux-mots 12x",), (None,), ("",), ("deux",)], "text string")
    assert {r.word: r.uses for r in scans.word_uses(df).collect()} == {"été": 2, "deux": 2, "mots": 1}
    assert scans.word_uses(df.limit(0)).count() == 0
