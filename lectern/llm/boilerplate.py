"""Lines that return in many documents of one source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.graph import connected_components
from lectern.session import broadcast_if_small, cut_lineage

#: A line must stand in so many documents of its source ...
LEAST_DOCUMENTS = 3
#: ... and in one in so many of the source's documents.
ONE_IN = 20


#: So many boilerplate lines at most are broadcast; more are joined by a shuffle.
BROADCAST_LINES = 100_000


def line_hashes(text: Column) -> Column:
    """A 16-byte hash for each line of a text, of its runs of letters in lower case; null for lines of fewer than three runs.

    What stands between runs is taken out of the whole text at once; line ends
    stay. Null texts have no lines.
    """
    runs = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\n]+", " "), "\n")
    return F.transform(runs, lambda x: F.when(F.trim(x).rlike("^[^ ]+ [^ ]+ ."), F.unhex(F.md5(F.trim(x)))))


def boilerplate(blocks: DataFrame, sources: DataFrame, least: int = LEAST_DOCUMENTS, one_in: int = ONE_IN) -> tuple[DataFrame, DataFrame]:
    """``document_id, block_id, line_no, component`` of every occurrence of a boilerplate line, and ``source, component, lines, documents, pieces`` of every boilerplate block.

    ``blocks``: ``document_id, block_id, page, reading_order, text``, in which
    repeated rows count once; ``sources``: ``document_id, source`` of the
    documents that count. The nodes of a source's graph are its lines, weighted
    by the number of documents they stand in; an edge joins two lines that
    follow each other on a page, weighted likewise. Nodes and edges stay if
    ``least`` documents and one in ``one_in`` of the source's have them. The
    connected components of what stays, a line without edges being one by
    itself, are the boilerplate blocks: what the components hold is looked up
    in the documents and named, and nothing else is. ``documents`` and
    ``pieces`` of a block count where it stands, whole or in part: runs of its
    lines that follow each other. Documents without a source, or whose source
    is null, make no case.

    Lines are hashed once, in the documents that count, and the hashes of each
    block written to the checkpoint folder; no text is shuffled. Support is
    counted over distinct (source, line, document), combined before the
    shuffle, so neither a source nor a document with a third of the rows is a
    hot key. The lines that stay are at most twenty times the lines of an
    average document for each source; they are broadcast if their count, which
    is taken, is small, and joined by shuffle otherwise.
    """
    owned = broadcast_if_small(cut_lineage(sources.filter("source is not null").select("document_id", "source", F.unhex(F.md5("document_id")).alias("doc"))), BROADCAST_LINES)
    sizes = owned.groupBy("source").agg(F.count(F.lit(1)).alias("source_documents"))
    enough = (F.col("n_documents") >= least) & (F.col("n_documents") * one_in >= F.col("source_documents"))
    support = lambda df, *key: df.select("source", *key, "doc").distinct().groupBy("source", *key).agg(F.count(F.lit(1)).alias("n_documents")).join(sizes, "source").filter(enough)

    where = ["document_id", "block_id", "page", "reading_order"]
    hashed = blocks.select(*where, "text").join(owned.select("document_id", "source", "doc"), "document_id").select(*where, "source", "doc", line_hashes(F.col("text")).alias("hashes"))
    held = cut_lineage(hashed.filter(F.exists("hashes", lambda x: x.isNotNull())))
    nodes = cut_lineage(support(held.select("source", "doc", F.explode(F.array_compact(F.array_distinct("hashes"))).alias("line")), "line").select("source", "line"))
    sized = F.broadcast if nodes.count() <= BROADCAST_LINES else (lambda df: df)
    seen = held.select(*where, "source", "doc", F.posexplode("hashes").alias("at", "line")).filter("line is not null").join(sized(nodes), ["source", "line"], "left_semi")
    kept = cut_lineage(seen.distinct())

    page = Window.partitionBy("source", "document_id", "page").orderBy("reading_order", "block_id", "at")
    pairs = kept.select("source", "doc", "line", F.lead("line").over(page).alias("next")).filter("next is not null and next <> line")
    ident = lambda c: F.unhex(F.md5(F.concat(F.col("source").cast("binary"), F.lit(b"\x00"), F.col(c))))
    edges = support(pairs, "line", "next").select(ident("line").alias("a"), ident("next").alias("b"))
    graph = cut_lineage(nodes.select("source", "line", ident("line").alias("node")))
    parts = connected_components(edges.unionByName(graph.select(F.col("node").alias("a"), F.col("node").alias("b"))))
    members = cut_lineage(graph.join(parts, "node").select("source", "line", F.hex("component").alias("component")))
    found = cut_lineage(kept.join(sized(members), ["source", "line"]).select("document_id", "block_id", (F.col("at") + 1).alias("line_no"), "source", "component", "page", "reading_order", "doc"))

    before = Window.partitionBy("source", "document_id", "page").orderBy("reading_order", "block_id", "line_no")
    begins = (~F.lag("component").over(before).eqNullSafe(F.col("component"))).cast("int")
    spread = found.select("source", "doc", "component", begins.alias("begins")).groupBy("source", "component", "doc").agg(F.sum("begins").alias("pieces")).groupBy("source", "component").agg(F.count(F.lit(1)).alias("documents"), F.sum("pieces").alias("pieces"))
    listed = members.groupBy("source", "component").agg(F.count(F.lit(1)).alias("lines")).join(spread, ["source", "component"])
    return found.select("document_id", "block_id", "line_no", "component"), listed


def without_lines(blocks: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """``blocks`` with every line named in ``found`` removed from ``text``.

    Texts without such a line, null and empty ones included, stay as they are;
    a text of which every line goes becomes empty.
    """
    drop = found.groupBy("document_id", "block_id").agg(F.collect_set("line_no").alias("_drop"))
    lines = F.filter(F.split(F.col(text), "\n"), lambda _, i: ~F.array_contains("_drop", i + 1))
    return blocks.join(drop, ["document_id", "block_id"], "left").withColumn(text, F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join(lines, "\n"))).drop("_drop")
