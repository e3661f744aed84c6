"""Cutting oversized items at natural boundaries."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cost of a cut by the kind of its place, from a section's title to the middle of a word.
COST = {"section": 0.0, "paragraph": 0.05, "line": 0.2, "sentence": 0.35, "clause": 1.2, "word": 2.0, "joint": 2.6, "inside": 4.5}
KINDS = list(COST)

#: Weight of the squared deviation of a piece from the mean size, and the cost of one more piece.
IMBALANCE, PIECE = 2.0, 1.0

_PLACES = [
    ("paragraph", re.compile(r"\n[^\S\n]*\n\s*")),
    ("line", re.compile(r"\n\s*")),
    ("sentence", re.compile(r"[.!?…؟。！？]+[\"'»”’)\]]*\s+")),
    ("clause", re.compile(r"[,;:،؛、，；：|–—]\s+")),
    ("word", re.compile(r"\s+")),
    ("joint", re.compile(r"(?<=\w)[/_\-]+(?=\w)|[_]")),
]

PIECES = "part_no int, n_parts int, core_start int, start int, end int, cut string, part string"


def boundaries(text: str, titles: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which the text may be cut before, in order, and the index of the kind of each."""
    kind: dict[int, int] = {}
    for name, pattern in _PLACES:
        for m in pattern.finditer(text):
            kind.setdefault(m.end(), KINDS.index(name))
    for title in titles:
        if title:
            for m in re.finditer(rf"(?:^|\n){re.escape(title)}\s*(?:\n|$)", text):
                kind[m.start() + text.startswith("\n", m.start())] = 0
    for end in (0, len(text)):
        kind.pop(end, None)
    at = np.array(sorted(kind), dtype=np.int64)
    return at, np.array([kind[i] for i in at.tolist()], dtype=np.int64)


def _safe(text: str, i: int) -> int:
    """The nearest place at or before ``i`` that parts no character from its marks."""
    while i > 0 and (unicodedata.combining(text[i]) or text[i] in "‍️" or text[i - 1] == "‍"):
        i -= 1
    return i


def _filled(text: str, at: np.ndarray, kind: np.ndarray, far: int, step: int, place) -> tuple[np.ndarray, np.ndarray]:
    """The places with ``inside`` places every ``step`` characters where neighbours lie further apart than ``far``; ``place`` shifts or refuses (-1) one."""
    ends = np.concatenate([[0], at, [len(text)]])
    wide = np.flatnonzero(np.diff(ends) > far)
    extra = {p for i in wide.tolist() for q in range(int(ends[i]) + step, int(ends[i + 1]), step) if (p := place(q)) > ends[i]}
    if not extra:
        return at, kind
    more = np.setdiff1d(np.fromiter(extra, dtype=np.int64), at)
    at, kind = np.concatenate([at, more]), np.concatenate([kind, np.full(len(more), len(KINDS) - 1)])
    order = np.argsort(at, kind="stable")
    return at[order], kind[order]


def candidates(text: str, titles: list[str], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places for the program, of which consecutive ones lie at most ``limit`` apart.

    Sentence ends and better are all offered; clause and word ends only where
    those lie more than a quarter of the limit apart, places inside words only
    where word ends do more than half of it, and a place between a letter and
    its marks only in runs of marks longer than the limit. The program's
    result is the best over these places.
    """
    at, kind = boundaries(text, titles)
    strong = np.concatenate([[0], at[kind <= 3], [len(text)]])
    gap = np.searchsorted(strong, at, side="right")
    offered = (kind <= 3) | (strong[np.minimum(gap, len(strong) - 1)] - strong[gap - 1] > limit // 4)
    step = max(1, limit // 40)
    at, kind = _filled(text, at[offered], kind[offered], limit // 2, step, lambda q: _safe(text, q))
    return _filled(text, at, kind, limit, step, lambda q: q)


def overlap_starts(text: str, cuts: np.ndarray, context: int) -> np.ndarray:
    """For each cut the place, at most ``context`` before it, where the next piece begins.

    The first sentence or line there, if it gives half the context or more;
    else the first word; else that many characters, moved forward where that
    would part a letter from its marks.
    """
    if context <= 0:
        return cuts.copy()
    at, kind = boundaries(text, [])
    out = []
    for c in cuts.tolist():
        lo, hi = np.searchsorted(at, c - context), np.searchsorted(at, c)
        near, what = at[lo:hi], kind[lo:hi]
        good = near[what <= 3]
        if len(good) and c - good[0] >= context // 2:
            out.append(int(good[0]))
        elif len(near) and c - near[0] >= context // 2:
            out.append(int(near[0]))
        else:
            i = max(0, c - context)
            while 0 < i < c and _safe(text, i) != i:
                i += 1
            out.append(i)
    return np.array(out, dtype=np.int64)


def split_text(text: str, limit: int, context: int = 0, titles: list[str] | None = None) -> list[tuple[int, int, int, str]]:
    """``(core start, start, end, kind of the cut before it)`` of the pieces of one text.

    Dynamic programming over the candidate places: the sum of cut costs, of
    squared deviations from the mean size and of a cost per piece is least
    over the places of :func:`candidates`, while no piece, overlap included,
    is longer than ``limit``; since places lie close enough, there always is
    such a set. Cores tile the
    text; a piece begins at most ``context`` characters before its core. A
    context of half the limit or more is cut down to less than half of it.
    """
    n, limit = len(text), max(1, limit)
    if n <= limit:
        return [(0, 0, n, "section")]
    context = max(0, min(context, (limit - 1) // 2))
    at, kind = candidates(text, titles or [], limit - context)
    p = np.concatenate([[0], at, [n]])
    cost = np.concatenate([[0.0], np.array([COST[k] for k in KINDS])[kind], [0.0]])
    begin = np.concatenate([[0], overlap_starts(text, at, context), [n]])
    ideal = n / np.ceil((n - context) / max(1, limit - context))
    best, back = np.full(len(p), np.inf), np.zeros(len(p), dtype=np.int64)
    best[0] = 0.0
    for j in range(1, len(p)):
        lo = int(np.searchsorted(p, p[j] - limit))
        fits = p[j] - begin[lo:j] <= limit
        total = np.where(fits, best[lo:j] + PIECE + IMBALANCE * ((p[j] - p[lo:j]) / ideal - 1.0) ** 2, np.inf)
        i = int(np.argmin(total)) if len(total) else 0
        if len(total) and np.isfinite(total[i]):
            best[j], back[j] = total[i] + cost[j], lo + i
    path = [len(p) - 1]
    while path[-1]:
        path.append(int(back[path[-1]]))
    path.reverse()
    kinds = ["section", *[KINDS[k] for k in kind], ""]
    return [(int(p[i]), int(begin[i]), int(p[j]), kinds[i]) for i, j in zip(path, path[1:])]


def split_oversized(items: DataFrame, keys: list[str], text: str, limit: str, context: str, titles: str | None = None) -> DataFrame:
    """The pieces of every item longer than its limit: ``keys, part_no, n_parts, core_start, start, end, cut, part``.

    ``limit`` and ``context`` name integer columns, ``titles`` an array of
    section titles. Lengths are compared in the JVM, so only oversized rows
    reach Python; a row is cut by itself, without a shuffle. Items within
    their limit, null texts and items with a null or non-positive limit give
    no rows; a null context is 0. Repeated items are cut repeatedly.
    """
    rest = F.coalesce(F.col(titles), F.array().cast("array<string>")) if titles else F.array().cast("array<string>")
    big = items.select(*keys, F.col(text).alias("_text"), F.col(limit).cast("int").alias("_limit"), F.coalesce(F.col(context), F.lit(0)).cast("int").alias("_context"), rest.alias("_titles"))
    big = big.filter((F.col("_limit") > 0) & (F.char_length("_text") > F.col("_limit")))
    schema = ", ".join([f"`{k}` {items.schema[k].dataType.simpleString()}" for k in keys] + [PIECES])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                *key, body, most, side, heads = row
                parts = split_text(body, most, side, [h for h in heads if h is not None])
                out += [(*key, i + 1, len(parts), core, start, end, cut, body[start:end]) for i, (core, start, end, cut) in enumerate(parts)]
            yield pd.DataFrame(out, columns=[*keys, "part_no", "n_parts", "core_start", "start", "end", "cut", "part"])

    return big.mapInPandas(run, schema)
