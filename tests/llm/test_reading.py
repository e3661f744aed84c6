from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import reading
from lectern.llm.queries import _levels
from lectern.sources.tables import table


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab.!é \n\t  　\u0085…à中", max_size=30), max_size=5))
def test_words_are_those_of_split(texts):
    words, first, rows, closed = reading.words_and_sentences(pa.array(texts, pa.string()))
    assert len(closed) == len(first)
    flat = words.dictionary_decode().to_pylist() if len(words) else []
    assert [flat[a:b] for a, b in zip(rows, rows[1:])] == [t.split() for t in texts]
    assert set(rows[:-1][np.diff(rows) > 0]) <= set(first.tolist())


def test_sentences():
    words, first, _, closed = reading.words_and_sentences(pa.array(["Ein Satz. Noch einer! Und\nmehr… ja", "z"], pa.string()))
    assert first.tolist() == [0, 2, 4, 5, 6, 7] and closed.tolist() == [True, True, False, True, False, False]


def test_held_out_passages_get_their_level(spark, folder):
    rows = sorted((r.text, r.reading_level) for r in table(spark, folder, "level_examples").collect())
    right = 0
    for k in range(4):
        model = reading.fit([x for i, x in enumerate(rows) if i % 4 != k])
        test = [x for i, x in enumerate(rows) if i % 4 == k]
        _, _, shares = reading.Scorer(model).rows(pa.array([t for t, _ in test]))
        got = reading._softmax(np.column_stack([shares, np.ones(len(test))]) @ model.document).argmax(1) + 1
        right += int((got == np.array([n for _, n in test])).sum())
    assert right >= 0.93 * len(rows)


def test_rows(spark, folder):
    examples = table(spark, folder, "level_examples")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "   \n"), (4, "ein wort " * 30_000), (4, "ein wort " * 30_000), (None, "a")], "doc_id bigint, text string").selectExpr("*", "1 as n_words", "2 as p1")
    got = sorted(((r.doc_id or 0, r.n_words, r.reading_level) for r in reading.reading_levels(docs, examples).collect()))
    assert [g[:2] for g in got] == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 60_000), (4, 60_000)]
    assert reading.reading_levels(docs.limit(0), examples).count() == 0


def test_probabilities_add_up(spark, folder):
    for r in _levels(spark, folder).limit(50).collect():
        assert (r.p1 is None and r.n_words == 0) or (abs(r.p1 + r.p2 + r.p3 - 1) < 1e-9 and 1 <= r.difficulty <= 3)
