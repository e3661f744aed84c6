from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import splitting


def check(text, limit, context, titles=()):
    parts = splitting.split_text(text, limit, context, list(titles))
    cores = [p[0] for p in parts] + [len(text)]
    assert cores[0] == 0 and cores == sorted(set(cores))
    assert all(end == nxt for (_, _, end, _), nxt in zip(parts, cores[1:]))
    for core, start, end, _ in parts:
        assert end - start <= limit and 0 <= core - start <= context
    assert "".join(text[a:b] for a, b in zip(cores, cores[1:])) == text
    return parts


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é.\n,!/_́", max_size=400), st.integers(5, 120), st.integers(0, 40))
def test_pieces_fit_and_lose_nothing(text, limit, context):
    if text:
        check(text, limit, min(context, (limit - 1) // 2))


def test_cuts_fall_on_the_best_places():
    text = ("Erster Satz ist hier. " * 8).strip() + "\n\n" + ("Zweiter Absatz steht da. " * 8).strip()
    parts = check(text, 260, 0)
    assert len(parts) == 2 and parts[1][3] == "paragraph"
    long = "Wort " * 100
    assert all(p[3] in ("section", "word") for p in check(long, 90, 20))


def test_section_titles_draw_the_cut():
    text = "a b c. " * 20 + "\nZwei\n" + "d e f. " * 20
    parts = check(text, 170, 0, ["Eins", "Zwei"])
    assert text[parts[1][0] :].startswith("Zwei\n")


def test_a_text_without_any_place_is_cut_by_length():
    check("x" * 5_000, 300, 50)
    check("́" * 500, 100, 10)
    check("a/b_c" * 3_000, 1_200, 80)


def test_the_overlap_is_real_at_paragraph_cuts():
    text = "\n\n".join("Ein Satz mit Worten steht hier und geht noch weiter. " * 5 for _ in range(6))
    for core, start, _, kind in check(text, 400, 100)[1:]:
        assert core - start >= 50 and not text[start].isspace()
        assert kind != "paragraph" or text[core - 1] == "\n"


def test_marks_without_end_keep_limit_and_overlap():
    parts = check("a" + "\u0301" * 700, 100, 20)
    assert len(parts) > 7


def brute(text, limit):
    """The least cost over all sets of places, without overlap."""
    at, kind = splitting.candidates(text, [], limit)
    p, cost = [0, *at.tolist(), len(text)], [0.0, *[splitting.COST[splitting.KINDS[k]] for k in kind], 0.0]
    ideal = len(text) / -(-len(text) // limit)
    best = {0: 0.0}
    for j in range(1, len(p)):
        best[j] = min((best[i] + splitting.PIECE + splitting.IMBALANCE * ((p[j] - p[i]) / ideal - 1) ** 2 for i in range(j) if p[j] - p[i] <= limit), default=float("inf")) + cost[j]
    return best[len(p) - 1]


@pytest.mark.parametrize("seed", range(8))
def test_the_program_finds_the_least_cost(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["wort ", "satz. ", "zeile\n", "absatz.\n\n", "teil, "]) for _ in range(120))
    parts = splitting.split_text(text, 150, 0)
    ideal = len(text) / -(-len(text) // 150)
    mine = sum(splitting.PIECE + splitting.IMBALANCE * ((e - c) / ideal - 1) ** 2 + (splitting.COST[k] if c else 0) for c, _, e, k in parts)
    assert mine == pytest.approx(brute(text, 150))


def test_rows(spark):
    rows = [(1, "wort " * 50, 100, 10, ["T"]), (2, "kurz", 100, 10, None), (3, None, 100, 10, None), (4, "wort " * 50, None, 10, None), (5, "wort " * 50, 0, 10, None), (6, "", 1, 1, [None]), (7, "wort " * 50, 100, None, [None]), (1, "wort " * 50, 100, 10, ["T"])]
    df = spark.createDataFrame(rows, "id int, text string, lim int, side int, heads array<string>").selectExpr("*", "'x' as part", "1 as start")
    got = splitting.split_oversized(df, ["id"], "text", "lim", "side", "heads").collect()
    assert sorted({r.id for r in got}) == [1, 7]
    assert len([r for r in got if r.id == 1]) == 2 * max(r.n_parts for r in got if r.id == 1)
    assert all(len(r.part) <= 100 for r in got)
    assert splitting.split_oversized(df.limit(0), ["id"], "text", "lim", "side").count() == 0
