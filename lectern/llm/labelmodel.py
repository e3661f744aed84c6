"""Noisy labelling functions combined by expectation maximisation.

Each function votes 1 (defect), -1 (sound) or 0 (nothing to say). For one
defect the votes of a row form a pattern; a corpus of any size has at most
three to the power of the number of functions patterns, so their counts, made
in one aggregation over all rows, are all the model needs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Defect:
    """A defect and what is believed of it before any row is seen: the share of defective rows and, for each labelling function, how often it votes 1 on defective and on sound rows."""

    name: str
    share: float
    functions: dict[str, tuple[float, float]]


def expectation_maximization(patterns: list[str], counts: np.ndarray, share: float, hits: list[tuple[float, float]], rounds: int = 60, weight: float = 30.0) -> np.ndarray:
    """The posterior of the defect for each pattern.

    Functions are taken as independent given the truth; a vote of 0 says
    nothing and is left out of the product. The first beliefs stay in as
    ``weight`` pseudo-rows on either side, so that a small table or a defect
    that never occurs can't turn the meaning of the votes.
    """
    votes = np.array([["-0+".index(c) - 1 for c in p] for p in patterns])
    plus, said = votes > 0, votes != 0
    first = np.array(hits).T  # rate of 1 among the votes on defective and on sound rows
    rate, prior = first.copy(), share
    for _ in range(rounds):
        weigh = lambda y: np.where(said, np.where(plus, np.log(rate[y]), np.log1p(-rate[y])), 0.0).sum(1)  # noqa: B023, E731
        odds = np.log(prior) - np.log1p(-prior) + weigh(0) - weigh(1)
        post = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        prior = float(np.clip((np.sum(post * counts) + weight * share) / (counts.sum() + weight), 1e-6, 0.5))
        for y, w in enumerate((post * counts, (1 - post) * counts)):
            rate[y] = np.clip((w @ plus + weight * first[y]) / (w @ said + weight), 1e-6, 1 - 1e-6)
    return post


def validated_cutoff(patterns: list[str], fitted: np.ndarray, held: np.ndarray, share: float, hits: list[tuple[float, float]]) -> float:
    """The cutoff at which the model agrees best with labelling functions it has not seen.

    Each function is left out in turn: the model is fitted without it on the
    rows counted in ``fitted``, and its posteriors are held against the left
    out function's votes on the rows counted in ``held``. The cutoff is the
    one of greatest F1 over all functions together, each weighted by how much
    more often it votes 1 on rows that all others together call defective than
    on the rest; of equal cutoffs the one nearest to a half. Where no function
    votes 1 on held rows it is a half. Cutoffs from 0.3 to 0.9 are tried: with
    a function less, posteriors are lower than those the cutoff is for.
    """
    grid = np.round(np.arange(0.3, 0.91, 0.05), 2)
    hit, named, true = np.zeros(len(grid)), np.zeros(len(grid)), 0.0
    for k in range(len(hits)):
        rest = [p[:k] + p[k + 1 :] for p in patterns]
        if not rest or not rest[0]:
            continue
        post = expectation_maximization(rest, fitted, share, hits[:k] + hits[k + 1 :])
        vote = np.array(["-0+".index(p[k]) - 1 for p in patterns])
        said, plus = fitted * (vote != 0), fitted * (vote > 0)
        on, off = (plus @ q / max(1e-9, said @ q) for q in (post, 1 - post))
        n = held * (vote != 0) * max(0.0, on - off) ** 2
        true += float((n * (vote > 0)).sum())
        for i, c in enumerate(grid):
            hit[i] += (n * ((post >= c) & (vote > 0))).sum()
            named[i] += (n * (post >= c)).sum()
    if not true:
        return 0.5
    f1 = np.round(2 * hit / np.maximum(named + true, 1e-9), 4)
    return float(min(grid[f1 == f1.max()], key=lambda c: (abs(c - 0.5), c)))


def label(rows: DataFrame, defects: list[Defect], keys: list[str]) -> DataFrame:
    """``keys, labels``: an array of ``(defect, posterior)`` of every defect whose posterior reaches its cutoff, in the order of ``defects``.

    ``rows`` has, for each defect, a column of its name with the votes of its
    functions as a string such as ``+0-``. One aggregation counts the patterns of all defects, split by a hash of the
    keys into two halves: the model is fitted on all rows, its cutoffs are
    validated on one half with models fitted on the other. The
    driver gets at most 2 * 3**functions counts for each defect.
    """
    half = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(2)).cast("int")
    coded = rows.select(*keys, half.alias("_half"), *[F.col(d.name).alias(f"_{d.name}") for d in defects])
    each = F.explode(F.array(*[F.struct(F.lit(d.name).alias("defect"), F.col(f"_{d.name}").alias("pattern")) for d in defects])).alias("x")
    counted = coded.select("_half", each).groupBy("_half", "x.defect", "x.pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    labels = []
    for d in defects:
        own = [r for r in counted if r["defect"] == d.name]
        patterns = sorted({r["pattern"] for r in own})
        if not patterns:
            labels.append(F.lit(None).cast("struct<defect:string,posterior:double>"))
            continue
        halves = np.zeros((2, len(patterns)))
        for r in own:
            halves[r["_half"], patterns.index(r["pattern"])] = r["n"]
        hits = list(d.functions.values())
        post = expectation_maximization(patterns, halves.sum(0), d.share, hits)
        cut = validated_cutoff(patterns, halves[0], halves[1], d.share, hits)
        known = F.create_map(*[F.lit(v) for p, q in zip(patterns, post) for v in (p, float(q))])
        q = F.try_element_at(known, F.col(f"_{d.name}"))
        labels.append(F.when(q >= cut - 1e-6, F.struct(F.lit(d.name).alias("defect"), q.alias("posterior"))))
    return coded.select(*keys, F.array_compact(F.array(*labels)).alias("labels"))
