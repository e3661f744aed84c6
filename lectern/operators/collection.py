"""Chunks of a document as a collection: duplicates merged, renumbered, eligible or not, counted and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.ordering import number
from lectern.operators.structure import duplicate_chunks

#: Why a chunk is not to be used.
EXCLUSIONS = ["empty_normalized_text", "missing_source_references", "administrative_furniture_only", "uncaptioned_asset_without_explanation"]


def retained(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """``chunks`` that are no duplicates, with ``position`` from 0 in place of the old index; ``pairs`` from :func:`duplicate_chunks`."""
    left = chunks.join(pairs.select("document_id", "chunk_id"), ["document_id", "chunk_id"], "left_anti")
    n = number(left.withColumn("_stretch", F.floor(F.col("chunk_index") / 1000)), ["document_id"], ["_stretch"], ["chunk_index", "chunk_id"], "position")
    return n.withColumn("position", F.col("position") - 1).drop("_stretch")


def inherited(pairs: DataFrame, holdings: DataFrame, *what: str) -> DataFrame:
    """``document_id, chunk_id, *what``: what duplicates hold (references, tables, assets), as rows of the chunk that stands for them.

    ``holdings``: ``document_id, chunk_id, *what``, a row for each thing held.
    Rows instead of arrays: a text that a document repeats without end hands on
    references without end. Equal things are handed on once, and not if the
    chunk holds them itself.
    """
    given = holdings.join(pairs, ["document_id", "chunk_id"]).select("document_id", F.col("canonical_id").alias("chunk_id"), *what).distinct()
    own = holdings.select("document_id", "chunk_id", *what)
    same = [given[c].eqNullSafe(own[c]) for c in ("document_id", "chunk_id", *what)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return given.join(own, on, "left_anti")


def eligibility(chunks: DataFrame, kinds: DataFrame) -> DataFrame:
    """``document_id, chunk_id, eligible, reasons``: whether a chunk can be used, and why not (joined by commas).

    ``chunks``: ``document_id, chunk_id, chunk_type, text, n_references``;
    ``kinds``: ``document_id, chunk_id, block_type``, a row for each block.
    """
    furniture = kinds.groupBy("document_id", "chunk_id").agg(F.bool_and(F.coalesce(F.col("block_type").isin("header", "footer"), F.lit(False))).alias("furniture"))
    c = chunks.withColumn("empty", X.blank(F.col("text"))).drop("text").join(furniture, ["document_id", "chunk_id"], "left")
    conditions = [F.col("empty"), F.coalesce("n_references", F.lit(0)) == 0, F.coalesce("furniture", F.lit(False)), (F.col("chunk_type") == "figure_context") & F.col("empty")]
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in zip(EXCLUSIONS, conditions)]))
    return c.select("document_id", "chunk_id", (F.size(reasons) == 0).alias("eligible"), F.array_join(reasons, ",").alias("reasons"))


def statistics(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Counts of every document's chunks, zeros where there are none.

    ``chunks``: ``document_id, chunk_id, chunk_index, chunk_type, text,
    n_references, eligible``. ``coverage`` is the share of chunks with
    references; ``types`` lists the chunk types with their counts.
    """
    size = F.length(F.coalesce("text", F.lit("")))
    c = chunks.withColumns({"size": size, "referred": F.coalesce("n_references", F.lit(0)) > 0})
    per = c.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.min("size").cast("bigint").alias("least"), F.max("size").cast("bigint").alias("most"), F.round(F.avg("size"), 4).alias("mean"), F.sum(X.token_estimate(F.col("size"))).alias("tokens"),
        F.round(F.count_if("referred") / F.count(F.lit(1)), 6).alias("coverage"), F.count_if(~F.col("referred")).alias("unreferred"), F.count_if("eligible").alias("eligible"), F.count_if(~F.col("eligible")).alias("excluded"),
    )
    types = c.groupBy("document_id", "chunk_type").agg(F.count(F.lit(1)).alias("n")).groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.coalesce("chunk_type", F.lit("none")), "n"))), ",").alias("types"))
    doubles = duplicate_chunks(c).groupBy("document_id").agg(F.count(F.lit(1)).alias("duplicates"))
    joined = documents.select("document_id").join(per, "document_id", "left").join(types, "document_id", "left").join(doubles, "document_id", "left")
    zero = lambda n, kind="bigint": F.coalesce(n, F.lit(0).cast(kind)).alias(n)
    return joined.select("document_id", *[zero(n) for n in ("chunks", "least", "most", "tokens", "unreferred", "eligible", "excluded", "duplicates")], zero("mean", "double"), zero("coverage", "double"), F.coalesce("types", F.lit("")).alias("types"))


def dataset_issues(chunks: DataFrame, documents: DataFrame, held: DataFrame, known: DataFrame) -> DataFrame:
    """``document_id, item, rule`` of what keeps chunks and documents from making one data set.

    ``chunks``: ``document_id, chunk_id, source_relative_path``; ``documents``:
    ``document_id, source_relative_path``; ``held``: ``document_id, chunk_id,
    object_id`` that chunks speak of; ``known``: ``document_id, object_id``.
    """
    row = lambda df, item, rule: df.select("document_id", item.alias("item"), F.lit(rule).alias("rule"))
    ids = documents.select("document_id", F.col("source_relative_path").alias("path"))
    parts = [
        row(chunks.join(ids, "document_id", "left_anti"), F.col("chunk_id"), "chunk_of_unknown_document"),
        row(documents.join(chunks.select("document_id"), "document_id", "left_anti"), F.lit(""), "document_without_chunks"),
        row(chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min("document_id").alias("document_id")).filter("n > 1"), F.col("chunk_id"), "chunk_id_repeated"),
        row(held.join(known, ["document_id", "object_id"], "left_anti").select("document_id", "chunk_id", "object_id").distinct(), F.concat_ws("/", "chunk_id", "object_id"), "object_unknown"),
        row(chunks.join(ids, "document_id").filter(F.col("source_relative_path").isNull()), F.col("chunk_id"), "source_path_missing"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
