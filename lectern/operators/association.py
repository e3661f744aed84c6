"""Tables and figures to the chunks that speak of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import cut_lineage

#: Pages in one bucket, by which objects and chunks meet.
BUCKET = 16

#: How a chunk was found, in the order of trust for tables and for assets.
TABLE_METHODS = ["explicit_block_reference", "caption_relationship", "unique_same_location"]
ASSET_METHODS = ["explicit_block_reference", "caption_relationship", "spatial_nearest", "unique_same_location"]

_AT = ["document_id", "object_id"]


def _sole(pairs: DataFrame, method: str) -> DataFrame:
    """Objects that a method gives to one chunk alone."""
    n = pairs.groupBy(*_AT).agg(F.min("chunk_id").alias("chunk_id"), F.max("chunk_id").alias("_last"))
    return n.filter("chunk_id = _last").select(*_AT, "chunk_id", F.lit(method).alias("method"))


def associate(objects: DataFrame, holders: DataFrame, chunks: DataFrame, members: DataFrame) -> DataFrame:
    """``document_id, object_id, chunk_id, method``: for each object the first method that names one chunk.

    ``objects`` (one row each): ``document_id, object_id, is_asset, block_id,
    page, top, caption`` (a key of the caption's text); ``holders``:
    ``document_id, object_id, block_id`` of all blocks that carry an asset;
    ``chunks``: ``document_id, chunk_id, first_page, last_page``; ``members``:
    ``document_id, chunk_id, chunk_index, block_id, top, key`` (the key of the
    block's text) of all blocks of all chunks.

    Explicit is the last chunk that holds a table's block, or the one chunk
    that holds blocks of an asset. The other methods look at chunks whose
    pages include the object's: one alone has a block that equals the caption;
    one alone has the block whose top is nearest to the asset's (a tie names
    none); one alone is there. Objects that no method places come with nulls,
    as do those without a page unless explicit.

    Objects meet chunks by an equi-join on buckets of pages with the exact
    range behind it, so a chunk over hundreds of pages is a few rows, and the
    pairs that meet are written to the checkpoint folder once.
    """
    bucket = lambda c: F.floor(F.col(c) / BUCKET)
    over = chunks.filter("first_page is not null and last_page is not null").select("document_id", "chunk_id", "first_page", "last_page", F.explode(F.sequence(bucket("first_page"), bucket("last_page"))).alias("_bucket"))
    place = objects.select(*_AT, "is_asset", "page", "top", "caption", bucket("page").alias("_bucket")).join(over, ["document_id", "_bucket"]).filter(F.col("page").between(F.col("first_page"), F.col("last_page")))
    place = cut_lineage(place.select(*_AT, "chunk_id", "is_asset", "top", "caption"))

    of_tables = objects.filter("not is_asset").join(members, ["document_id", "block_id"]).groupBy(*_AT).agg(F.max(F.struct("chunk_index", "chunk_id")).alias("_x")).select(*_AT, F.col("_x.chunk_id").alias("chunk_id"), F.lit("explicit_block_reference").alias("method"))
    of_assets = _sole(holders.join(members, ["document_id", "block_id"]).select(*_AT, "chunk_id"), "explicit_block_reference")
    equal = place.filter("caption is not null").join(members.select("document_id", "chunk_id", F.col("key").alias("caption")), ["document_id", "chunk_id", "caption"], "left_semi")
    far = place.filter("is_asset and top is not null").join(members.filter("top is not null").select("document_id", "chunk_id", F.col("top").alias("_top")), ["document_id", "chunk_id"]).groupBy(*_AT, "chunk_id").agg(F.min(F.abs(F.col("top") - F.col("_top"))).alias("_far"))
    least = far.groupBy(*_AT).agg(F.min("_far").alias("_far"))
    found = of_tables
    for more in (of_assets, _sole(equal, "caption_relationship"), _sole(far.join(least, [*_AT, "_far"]), "spatial_nearest"), _sole(place, "unique_same_location")):
        found = found.unionByName(more)
    trust = F.array_position(F.array(*[F.lit(m) for m in ASSET_METHODS]), F.col("method"))
    best = found.groupBy(*_AT).agg(F.min(F.struct(trust.alias("trust"), "chunk_id", "method")).alias("_x"))
    return objects.select(*_AT).join(best, _AT, "left").select(*_AT, F.col("_x.chunk_id").alias("chunk_id"), F.col("_x.method").alias("method"))
