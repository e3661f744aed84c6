"""Reading level of documents from the levels of their sentences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.fragments import after_wide_space, bytes_of, slices

LEVELS = 3

#: Graded passages used for fitting at most; more are an error.
MOST_EXAMPLES = 5_000

#: How much more the weights of a sentence's length and word length are shrunk than those of words and characters.
SHAPE_RIDGE = 5.0

#: Words of a sentence that count in full; shorter stretches weigh less.
FULL_WORDS = 6

#: Weight of a stretch without a closing mark (a heading, a notice), which is no sentence but all that some texts have.
UNCLOSED = 0.1

_STRIP = "\"'«»“”‘’()[]{}<>.,;:!?…-–—*|/·•"


def _grams(word: str) -> list[str]:
    """The features of a word: the word itself and its runs of three and four characters, ends marked."""
    w = f"^{word}$"
    return ["=" + word, *[w[i : i + n] for n in (3, 4) for i in range(len(w) - n + 1)]]


@dataclass(frozen=True)
class Model:
    """Weights of the sentence model, one row per feature, and of the document model."""

    features: dict[str, int]
    weights: np.ndarray
    shape: np.ndarray
    document: np.ndarray


def words_and_sentences(text: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the rows (runs of characters other than white space), the first word of each sentence, the first word of each row (with the end), and whether each sentence has a closing mark.

    A sentence ends at ``.``, ``!``, ``?`` or ``…`` before white space, at a
    line end and with its row. Found in passes over the bytes of the column.
    """
    offsets, data = bytes_of(text)
    n = len(data)
    ascii_space = np.zeros(256, dtype=bool)
    ascii_space[list(b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ")] = True
    space = ascii_space[data]
    last = np.flatnonzero((data == 0xA0) | (data == 0x85) | ((data >= 0x80) & (data <= 0x8A)) | (data == 0xA8) | (data == 0xA9) | (data == 0xAF) | (data == 0x9F))
    if len(last):
        wide = last[after_wide_space(data, last + 1)]
        space[wide] = True
        space[wide - 1] = True
        three = wide[data[wide - 1] < 0xC0]
        space[three - 2] = True
    word = ~space
    begin = word.copy()
    begin[1:] &= space[:-1]
    row_start = np.zeros(n + 1, dtype=bool)
    row_start[offsets] = True
    begin |= word & row_start[:n]
    starts = np.flatnonzero(begin)
    stop = np.zeros(n, dtype=bool)
    stop[:-1] = word[:-1] & (space[1:] | row_start[1:n])
    if n:
        stop[-1] = word[-1]
    ends = np.flatnonzero(stop) + 1
    lengths = ends - starts
    packed = data[word] if n else data
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(packed))]).dictionary_encode()
    rows = np.searchsorted(starts, offsets)
    first = np.zeros(len(starts) + 1, dtype=bool)
    first[rows] = True
    tail = data[ends - 1] if len(ends) else data[:0]
    closed = np.isin(tail, np.frombuffer(b".!?", dtype=np.uint8)) | ((tail == 0xA6) & (data[np.maximum(ends - 3, 0)] == 0xE2) if len(ends) else np.zeros(0, dtype=bool))
    if len(starts) > 1:
        breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
        first[1:-1] |= closed[:-1] | (breaks[starts[1:]] > breaks[ends[:-1]])
    begins = np.flatnonzero(first[: len(starts)])
    return words, begins, rows, closed[np.append(begins[1:], len(starts)) - 1] if len(begins) else np.zeros(0, dtype=bool)


def _weights(sums: np.ndarray, closed: np.ndarray) -> np.ndarray:
    """What a sentence counts for in its document."""
    return np.minimum(sums[:, LEVELS], FULL_WORDS) / FULL_WORDS * np.where(closed, 1.0, UNCLOSED)


class Scorer:
    """Applies a model to Arrow arrays; remembers the words it has scored."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[str, tuple[float, ...]] = {}

    def _word(self, raw: str) -> tuple[float, ...]:
        w = raw.strip(_STRIP).lower()
        if not any(c.isalpha() for c in w):
            return (0.0,) * (LEVELS + 2)
        at = [i for g in _grams(w) if (i := self.model.features.get(g)) is not None]
        score = self.model.weights[at].sum(0) if at else np.zeros(LEVELS)
        return (*score.tolist(), 1.0, float(len(w)))

    def _vectors(self, words: list[str]) -> np.ndarray:
        if len(self.known) > 400_000:
            self.known = {}
        known, out = self.known, []
        for w in words:
            v = known.get(w)
            if v is None:
                v = known[w] = self._word(w)
            out.append(v)
        return np.array(out, dtype=np.float64).reshape(len(words), LEVELS + 2)

    def rows(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: words, sentences, and the mean distribution of its sentences over the levels."""
        words, first, rows, closed = words_and_sentences(text)
        n_words = np.diff(rows)
        shares = np.full((len(text), LEVELS), 1.0 / LEVELS)
        if not len(words):
            return n_words, np.zeros(len(text), dtype=np.int64), shares
        sums = np.add.reduceat(self._vectors(words.dictionary.to_pylist())[words.indices.to_numpy()], first, axis=0)
        p = sentence_probabilities(sums, self.model.shape)
        weight = _weights(sums, closed)
        begin = np.searchsorted(first, rows)
        run = np.concatenate([np.zeros((1, LEVELS + 1)), np.cumsum(np.column_stack([p * weight[:, None], weight]), axis=0)])
        total = run[begin[1:]] - run[begin[:-1]]
        some = total[:, LEVELS] > 1e-9
        shares[some] = total[some, :LEVELS] / total[some, LEVELS:]
        return n_words, np.diff(begin), shares


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _shape_features(sums: np.ndarray) -> np.ndarray:
    n = np.maximum(sums[:, LEVELS], 1.0)
    return np.column_stack([np.ones(len(n)), np.log(n) - 2.3, sums[:, LEVELS + 1] / n / 6 - 1])


def sentence_probabilities(sums: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Distribution of each sentence: the mean score of its words plus its length and word length."""
    n = np.maximum(sums[:, LEVELS : LEVELS + 1], 1.0)
    return _softmax(sums[:, :LEVELS] / n + _shape_features(sums) @ shape)


def _fit_softmax(x: np.ndarray, q: np.ndarray, ridge: float, rounds: int = 250) -> np.ndarray:
    """Softmax regression on soft targets with a ridge: gradient descent with momentum."""
    w, speed = np.zeros((x.shape[1], q.shape[1])), 0.0
    step = 1.0 / (0.5 * np.linalg.norm(x, 2) ** 2 / len(x) + ridge)
    for _ in range(rounds):
        g = x.T @ (_softmax(x @ w) - q) / len(x) + ridge * w
        speed = 0.9 * speed - step * g
        w = w + speed
    return w


def _fit_sentences(x: np.ndarray, of: np.ndarray, level: np.ndarray, ridge: float) -> np.ndarray:
    """The sentence model from passages of known level, by expectation maximisation: a passage is mostly, not only, made of sentences of its level."""
    q = np.eye(LEVELS)[level[of]]
    mix = np.full((LEVELS, LEVELS), 0.15) + 0.55 * np.eye(LEVELS)
    w = _fit_softmax(x, q, ridge)
    for _ in range(3):
        post = _softmax(x @ w) * mix[level[of]]
        q = post / post.sum(1, keepdims=True)
        counts = np.array([q[level[of] == k].sum(0) for k in range(LEVELS)]) + 2 * np.eye(LEVELS) + 0.5
        mix = counts / counts.sum(1, keepdims=True)
        w = _fit_softmax(x, q, ridge)
    return w


def fit(examples: list[tuple[str, int]], folds: int = 5, ridge: float = 2e-4) -> Model:
    """Fit both models on graded passages (text, level from 1).

    Sentence weights are shrunk towards 0; they are found in the space of the
    sentences (there are fewer of them than features), which gives the same. The document model maps the mean
    distribution of a passage's sentences to its level; it is fitted on
    distributions that come from sentence models which have not seen the
    passage, so it is calibrated for new documents.
    """
    texts = pa.array([t for t, _ in examples], pa.string())
    level = np.array([k - 1 for _, k in examples])
    words, first, rows, closed = words_and_sentences(texts)
    vocabulary = [w.strip(_STRIP).lower() for w in words.dictionary.to_pylist()]
    features: dict[str, int] = {}
    grams = [[features.setdefault(g, len(features)) for g in _grams(w)] if any(c.isalpha() for c in w) else [] for w in vocabulary]
    sentence = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(words))))
    n_features = len(features)
    x = np.zeros((len(first), n_features + 3))
    sums = np.zeros((len(first), LEVELS + 2))
    for s, w in zip(sentence, words.indices.to_numpy()):
        if grams[w]:
            x[s, grams[w]] += 1.0
            sums[s, LEVELS] += 1
            sums[s, LEVELS + 1] += len(vocabulary[w])
    x[:, :n_features] /= np.maximum(sums[:, LEVELS : LEVELS + 1], 1.0)
    x[:, n_features:] = _shape_features(sums)
    common = (x[:, :n_features] > 0).sum(0) >= 2
    keep = np.append(common, [True] * 3)
    of = np.searchsorted(rows, first, side="right") - 1
    scale = 1 / np.sqrt(np.append(np.ones(int(common.sum())), [SHAPE_RIDGE] * 3))
    scaled = x[:, keep] * scale
    values, vectors = np.linalg.eigh(scaled @ scaled.T)
    some = values > 1e-9 * values.max()
    x = vectors[:, some] * np.sqrt(values[some])
    means = np.zeros((len(examples), LEVELS))
    fold = np.arange(len(examples)) % folds
    weight = _weights(sums, closed)

    def mean(w: np.ndarray, at: np.ndarray) -> np.ndarray:
        p = _softmax(x[at] @ w) * weight[at, None]
        total, n = np.zeros((len(examples), LEVELS)), np.zeros(len(examples))
        np.add.at(total, of[at], p)
        np.add.at(n, of[at], weight[at])
        return total / np.maximum(n, 1e-9)[:, None]

    for k in range(folds):
        train, test = fold[of] != k, np.flatnonzero(fold[of] == k)
        if train.any() and len(test):
            means[fold == k] = mean(_fit_sentences(x[train], of[train], level, ridge), test)[fold == k]
    w = scale[:, None] * (scaled.T @ (vectors[:, some] / np.sqrt(values[some]) @ _fit_sentences(x, of, level, ridge)))
    document = _fit_softmax(np.column_stack([means, np.ones(len(examples))]), np.eye(LEVELS)[level], 1e-3, 2000)
    names = [g for g, i in features.items() if common[i]]
    return Model({g: i for i, g in enumerate(names)}, w[: len(names)], w[len(names) :], document)


def reading_levels(documents: DataFrame, examples: DataFrame, key: str = "doc_id", text: str = "text", level: str = "reading_level") -> DataFrame:
    """``key, n_words, n_sentences, p1, p2, p3, reading_level, difficulty`` of every document.

    ``p1`` to ``p3`` are the calibrated probabilities of the document's level,
    ``reading_level`` the likeliest, ``difficulty`` the mean level. The model
    is fitted on the driver from the graded passages (at most MOST_EXAMPLES,
    more are an error); documents are scored by a narrow map over Arrow
    batches, each distinct word once in a batch. Null texts and texts
    without words have no level: nulls; repeated rows are scored repeatedly.
    """
    graded = [(r[0], r[1]) for r in examples.select(text, level).filter(f"`{text}` is not null and `{level}` is not null").limit(MOST_EXAMPLES + 1).collect()]
    if not graded or len(graded) > MOST_EXAMPLES:
        raise ValueError(f"expected 1 to {MOST_EXAMPLES} graded passages, got {len(graded)}")
    model = fit(sorted(graded))
    kind = documents.schema[key].dataType.simpleString()
    names = ["k", "n_words", "n_sentences", "p1", "p2", "p3", "reading_level", "difficulty"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            parts = [scorer.rows(piece) for piece in slices(b.column(1))]
            if not parts:
                continue
            n_words, n_sentences, shares = (np.concatenate(c) for c in zip(*parts))
            p = _softmax(np.column_stack([shares, np.ones(len(shares))]) @ model.document)
            none = n_words == 0
            columns = [b.column(0), pa.array(n_words, pa.int32()), pa.array(n_sentences, pa.int32()), *[pa.array(p[:, i], mask=none) for i in range(LEVELS)], pa.array(p.argmax(1) + 1, pa.int32(), mask=none), pa.array(p @ np.arange(1.0, LEVELS + 1), mask=none)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"k {kind}, n_words int, n_sentences int, p1 double, p2 double, p3 double, reading_level int, difficulty double"
    return documents.select(key, text).mapInArrow(run, schema).withColumnRenamed("k", key)
