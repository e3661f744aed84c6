from __future__ import annotations

import numpy as np

from lectern.llm import labelmodel, pairs

NOTE = "zelmiome (diapo)\nune raideur ?\ndébut rastoprin 12 mg ; 3 prises\nretour 9 sem"
GOOD = "Le signe principal de la zelmiome est une raideur. Le patient reçoit rastoprin (12 mg, 3 fois par jour) et il est revu après 9 semaines."


def cases():
    good = [("d", f"g{i}", NOTE, GOOD) for i in range(12)]
    return good + [
        ("d", "e1", NOTE, None), ("d", "e2", NOTE, ""), ("d", "e3", NOTE, " ​\n"), ("d", "e4", NOTE, "N/A"), ("d", "e5", NOTE, "[no output]"), ("d", "e6", NOTE, "```\n```"),
        ("d", "t1", NOTE, GOOD[:60]), ("d", "t2", NOTE, GOOD[:80] + "…"), ("d", "t3", NOTE, "| Constat | Dose |\n| raideur | 12"),
        ("d", "r1", NOTE, "Je suis désolé, mais je ne peux pas réécrire ces notes."), ("d", "r2", NOTE, "I'm sorry, but I can't help with that request."),
        ("d", "c1", NOTE, NOTE), ("d", "c2", NOTE, f"« {NOTE.upper()} »"), ("d", "c3", NOTE, "Texte reconstruit : " + NOTE.replace("\n", " ")),
        ("d", "o1", NOTE, "The main sign of zelmiome is stiffness. The patient receives rastoprin (12 mg, 3 times a day) and is seen again after 9 weeks."),
        ("d", "n1", None, GOOD), (None, "n2", NOTE, GOOD), ("d", "g0", NOTE, GOOD),
    ]


def test_each_defect_is_named(spark):
    df = spark.createDataFrame(cases(), "document_id string, transformation_id string, original_text string, reconstructed_text string").selectExpr("*", "'x' as o", "'y' as language")
    langs = spark.createDataFrame([("d", "fr-FR")], "document_id string, language string")
    got = {r.transformation_id: r.defect for r in pairs.one_defect(pairs.defective_pairs(df, langs)).collect()}
    names = {"e": "empty", "t": "truncated", "r": "refusal", "c": "copy", "o": "other_language"}
    assert got == {k: names[k[0]] for _, k, _, _ in cases() if k[0] in names}


def test_empty_table(spark):
    df = spark.createDataFrame([], "document_id string, transformation_id string, original_text string, reconstructed_text string")
    langs = spark.createDataFrame([], "document_id string, language string")
    assert pairs.defective_pairs(df, langs).count() == 0


def test_rare_languages_are_learnt(spark):
    rows = [("d", f"g{i}", NOTE, GOOD) for i in range(300)]
    finnish = "Potilas saa lääkettä kolme kertaa päivässä ja hänet tutkitaan uudelleen yhdeksän viikon kuluttua."
    rows += [("f", f"f{i}", NOTE, finnish) for i in range(2)] + [("d", "odd", NOTE, finnish), ("d", "none", NOTE, "[" + "x" * 300 + "]")]
    df = spark.createDataFrame(rows, "document_id string, transformation_id string, original_text string, reconstructed_text string")
    told = spark.createDataFrame([("d", "fr"), ("f", "fi")], "document_id string, language string")
    words = pairs.language_words(df.join(told, "document_id"), "language", ["reconstructed_text"])
    assert {"potilas", "lääkettä"} <= set(words["fi"])
    got = {r.transformation_id: r.defect for r in pairs.one_defect(pairs.defective_pairs(df, told)).collect()}
    assert got["odd"] == "other_language" and "g0" not in got
    assert pairs.wrapped("[" + "y" * 5000 + "]") and not pairs.wrapped("word [x]") and pairs.wrapped(" - ")


def test_the_model_learns_what_a_function_is_worth():
    r = np.random.default_rng(5)
    truth = r.random(20_000) < 0.1
    votes = np.stack([np.where(r.random(20_000) < np.where(truth, a, b), 1, -1) for a, b in ((0.9, 0.05), (0.8, 0.02), (0.5, 0.5))], 1)
    votes[r.random(votes.shape) < 0.2] = 0
    keys, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    patterns = ["".join("-0+"[v + 1] for v in k) for k in keys]
    post = labelmodel.expectation_maximization(patterns, counts.astype(float), 0.05, [(0.7, 0.1), (0.7, 0.1), (0.7, 0.3)])
    cut = labelmodel.validated_cutoff(patterns, counts / 2, counts / 2, 0.05, [(0.7, 0.1), (0.7, 0.1), (0.7, 0.3)])
    found = post[back.reshape(-1)] >= cut
    assert (found & truth).sum() / found.sum() > 0.72 and (found & truth).sum() / truth.sum() > 0.75


def test_a_defect_that_never_occurs_stays_rare():
    post = labelmodel.expectation_maximization(["--", "-0", "0-"], np.array([900.0, 50.0, 50.0]), 0.03, [(0.9, 0.01), (0.8, 0.02)])
    assert (post < 0.05).all()


def test_very_long_texts_and_runs_of_signs():
    for r in ("mot " * 300_000, "(" * 200_000 + "a", "." * 200_000 + "a", "-" * 200_000, "« " * 50_000):
        assert len(pairs.look_at(NOTE, r, {}).votes) == 4
