"""Token ids and token budgets of a corpus under a public tokenizer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.fragments import FragmentTokenizer, slices, tokenizer
from lectern.session import cut_lineage

#: Where the rank file lies on the driver; a parameter of each operator.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Hashes of repeated texts that are broadcast at most (8 bytes each).
REPEATED = 2_000_000


def shipped(df: DataFrame, ranks: str) -> Callable[[], FragmentTokenizer]:
    """What gives a Python worker its tokenizer: the driver serves the rank file to all executors, those that join later too, once for each context."""
    context = df.sparkSession.sparkContext
    sent = context.__dict__.setdefault("_lectern_ranks", set())
    if ranks not in sent:
        context.addFile(ranks)
        sent.add(ranks)
    name = ranks.rsplit("/", 1)[-1]
    return lambda: tokenizer(SparkFiles.get(name))


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """``key, ids``: the token ids of every text, without special tokens.

    A narrow map over Arrow batches: no shuffle, one column read beside the
    key, and ids handed on slice by slice, so a batch of long texts needs no
    more memory than its texts. Null and empty texts give an empty list;
    strings of special tokens are ordinary text; repeated rows and null keys
    are kept as they are; an empty table gives no rows. Other columns, whatever
    their names, are not read.
    """
    kind = df.schema[key].dataType.simpleString()
    load = shipped(df, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load()
        for b in batches:
            at = 0
            for piece in slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(piece)), encoder.encode(piece)], names=["k", "ids"])
                at += len(piece)

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def count_tokens(df: DataFrame, text: str, into: str = "n_tokens", ranks: str = RANKS) -> DataFrame:
    """``df`` without ``text``, with the number of tokens in ``into`` (0 for null and empty texts). Narrow."""
    rest = [c for c in df.columns if c != text]
    schema = df.select(*[F.col(f"`{c}`") for c in rest], F.lit(0).cast("bigint").alias(into)).schema
    load = shipped(df, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load()
        for b in batches:
            n = pa.array(encoder.counts(b.column(len(rest))), type=pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], n], names=[*rest, into])

    return df.select(*[F.col(f"`{c}`") for c in [*rest, text]]).mapInArrow(run, schema)


def text_key(text: str = "text") -> Column:
    """Identity of a whole text: its SHA-256 as 32 bytes; null and empty texts are one text."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def distinct_counts(df: DataFrame, text: str = "text", ranks: str = RANKS) -> DataFrame:
    """``text_hash, n_tokens`` of every distinct text, each tokenized once.

    Which texts are repeated is found first, by the short hashes that occur
    more than once. If these are few enough to be broadcast (``REPEATED``),
    the other texts are tokenized where they are read, and only repeated ones
    are shuffled, merged before and after by their full hash, so a text that
    makes up a third of all rows reaches the tokenizer as one row. Else all
    texts are.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    short = df.select(body.alias("body")).withColumn("_short", F.xxhash64("body"))
    again = cut_lineage(short.groupBy("_short").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_short"))
    merged = lambda rows: rows.select(text_key("body").alias("text_hash"), "body").dropDuplicates(["text_hash"])
    if again.count() > REPEATED:
        return count_tokens(merged(short), "body", ranks=ranks)
    few = F.broadcast(again)
    sole = short.join(few, "_short", "left_anti").select(text_key("body").alias("text_hash"), "body")
    return count_tokens(sole.unionByName(merged(short.join(few, "_short", "left_semi"))), "body", ranks=ranks)


def token_table(df: DataFrame, keys: list[str], text: str = "text", ranks: str = RANKS) -> DataFrame:
    """``keys, n_tokens`` of every row: distinct texts are tokenized once and the counts joined back by hash.

    The rows that go into the join carry the hash, not the text. A hash that
    many rows share is spread by adaptive skew handling on the side of the
    rows; the side of the counts has one row per hash. Repeated rows stay
    repeated; null texts count 0.
    """
    rows = df.select(*keys, text_key(text).alias("text_hash"))
    return rows.join(distinct_counts(df, text, ranks), "text_hash").select(*keys, "n_tokens")


def _sums() -> list[Column]:
    return [F.sum("n").alias("items"), F.count(F.lit(1)).alias("texts"), F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("n")).alias("tokens_with_copies")]


def slice_totals(items: DataFrame, counts: DataFrame, slices: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """``by, dimension, slice, items, texts, tokens, tokens_with_copies``: how much text each slice of each dimension holds.

    ``items``: rows with ``text_hash``, the columns ``by`` and the slices;
    ``counts``: ``text_hash, n_tokens``. Items are first reduced to (hash,
    slice, multiplicity) for each dimension, with map-side combination, and
    only then joined with the counts, so a text or slice that holds a third of
    the rows is small before anything moves.
    """
    by, columns = by or [], list(dict.fromkeys(slices.values()))
    pair = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.coalesce(F.col(c), F.lit("(none)")).alias("slice")) for n, c in slices.items()]))
    uses = items.groupBy("text_hash", *by, *columns).agg(F.count(F.lit(1)).alias("n")).select("text_hash", *by, pair.alias("at"), "n").groupBy("text_hash", *by, "at.dimension", "at.slice").agg(F.sum("n").alias("n"))
    return uses.join(counts, "text_hash").groupBy(*by, "dimension", "slice").agg(*_sums())


def cell_totals(items: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
    """``by, items, texts, tokens, tokens_with_copies`` of every combination of the columns ``by`` that occurs; nulls are ``(none)``."""
    uses = items.select("text_hash", *[F.coalesce(F.col(c), F.lit("(none)")).alias(c) for c in by]).groupBy("text_hash", *by).agg(F.count(F.lit(1)).alias("n"))
    return uses.join(counts, "text_hash").groupBy(*by).agg(*_sums())


def token_totals(items: DataFrame, slices: dict[str, str], text: str = "text", ranks: str = RANKS) -> DataFrame:
    """``dimension, slice, items, texts, tokens, tokens_with_copies`` of items with their texts (see :func:`slice_totals`).

    ``slices`` maps the name of a dimension to the column that holds the slice
    of an item. ``texts`` and ``tokens`` count every distinct text once in a
    slice, ``items`` and ``tokens_with_copies`` as often as it occurs. A null
    slice is the slice ``(none)``; null and empty texts are one text of 0
    tokens; an empty table has no slices.
    """
    hashed = items.select(text_key(text).alias("text_hash"), *dict.fromkeys(slices.values()))
    return slice_totals(hashed, distinct_counts(items, text, ranks), slices)
