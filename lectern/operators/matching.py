"""Blocks against raw text: what is missing, and which raw block a block came from."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import cut_lineage

#: A block is matched if one raw block of its page is so similar and no other comes so near.
LEAST, MARGIN = 0.82, 0.05


def pages_without_text(raw: DataFrame, blocks: DataFrame) -> DataFrame:
    """Raw blocks with text on pages where no block has any: what a structured parser lost. Null pages match no page."""
    seen = blocks.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select("document_id", "page").distinct()
    return raw.filter(F.trim(F.coalesce("text", F.lit(""))) != "").join(seen, ["document_id", "page"], "left_anti")


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity by matching runs; 0 where cheap upper bounds already exclude a match or a rival."""
    out = []
    for x, y in zip(a, b):
        m = SequenceMatcher(None, x, y, autojunk=False)
        out.append(m.ratio() if m.real_quick_ratio() >= LEAST - MARGIN and m.quick_ratio() >= LEAST - MARGIN else 0.0)
    return pd.Series(out)


def match_raw(blocks: DataFrame, raw: DataFrame) -> DataFrame:
    """``document_id, block_id, raw_block_id, ratio`` of every block that one raw block of its page matches, with a margin to the next.

    ``blocks``: ``document_id, block_id, page, text``; ``raw``: the same with
    ``raw_block_id``. Candidates meet on (document, page) if their lengths
    allow a match or a rival; of those, Python compares the ones whose
    characters allow it. Ratios are written to the checkpoint folder, so each
    pair is compared once. Null and blank texts match nothing.
    """
    key = lambda df, i: df.select("document_id", "page", F.col(i), F.regexp_replace(F.lower(F.trim("text")), r"\s+", " ").alias("t")).filter("t <> ''").withColumn("n", F.length("t"))
    b, r = key(blocks, "block_id"), key(raw, "raw_block_id").withColumnsRenamed({"t": "rt", "n": "rn"})
    ratio = F.pandas_udf(_ratio, "double")
    able = F.least("n", "rn") * 2.0 >= F.lit(LEAST - MARGIN) * (F.col("n") + F.col("rn"))
    met = b.join(r, ["document_id", "page"]).filter(able)
    same = met.filter("t = rt").select("document_id", "block_id", "raw_block_id", F.lit(1.0).alias("ratio"))
    near = met.filter("t <> rt").select("document_id", "block_id", "raw_block_id", ratio("t", "rt").alias("ratio"))
    every = cut_lineage(same.unionByName(near.filter(F.col("ratio") > 0)))
    top = every.groupBy("document_id", "block_id").agg(F.max(F.struct("ratio", "raw_block_id")).alias("best"))
    rivals = every.join(top, ["document_id", "block_id"]).filter((F.col("raw_block_id") != F.col("best.raw_block_id")) & (F.col("ratio") > F.col("best.ratio") - MARGIN)).select("document_id", "block_id").distinct()
    good = top.filter(F.col("best.ratio") >= LEAST).join(rivals, ["document_id", "block_id"], "left_anti")
    return good.select("document_id", "block_id", F.col("best.raw_block_id").alias("raw_block_id"), F.round("best.ratio", 6).alias("ratio"))


def reference_order(references: DataFrame, ordered: DataFrame) -> DataFrame:
    """``document_id, chunk_id, references, unknown, reordered, gaps`` of chunks whose references are arrays of block ids in order.

    ``references``: ``document_id, chunk_id, at, block_id`` (one row a
    reference); ``ordered``: ``document_id, block_id, ordinal``. ``reordered``
    counts steps backwards, ``gaps`` blocks left out between the first and last.
    """
    known = references.join(ordered.select("document_id", "block_id", "ordinal"), ["document_id", "block_id"], "left")
    row = F.struct("at", "ordinal")
    g = known.groupBy("document_id", "chunk_id").agg(F.array_sort(F.collect_list(row)).alias("r"), F.count(F.lit(1)).alias("references"), F.count_if(F.col("ordinal").isNull()).alias("unknown"), F.countDistinct("ordinal").alias("_d"), F.min("ordinal").alias("_lo"), F.max("ordinal").alias("_hi"))
    steps = F.filter(F.col("r.ordinal"), lambda x: x.isNotNull())
    back = F.size(F.filter(F.zip_with(steps, F.slice(steps, F.lit(2), F.greatest(F.size(steps), F.lit(1))), lambda a, b: b < a), lambda x: F.coalesce(x, F.lit(False))))
    return g.select("document_id", "chunk_id", "references", "unknown", back.cast("bigint").alias("reordered"), F.coalesce(F.col("_hi") - F.col("_lo") + 1 - F.col("_d"), F.lit(0)).cast("bigint").alias("gaps"))
