"""Chunks built from units: atoms, runs of plain and of list atoms, packing with the short tail merged back, types and ids."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.ordering import number, running
from lectern.operators.structure import Limits, structural_units
from lectern.session import cut_lineage

#: What a table, figure or formula makes of its atom.
MAIN = {"table": "table_context", "figure": "figure_context", "formula": "formula_context"}

SCHEMA = "1.0.0"

_MADE = "document_id string, unit bigint, pack bigint, forced string, first boolean, titled boolean, preamble boolean, scope string, section_id string, blocks array<string>, fragment int, text string, first_page int, last_page int, indivisible boolean, location_type string"


def fragments(text: str, most: int) -> list[str]:
    """Sentences and lines packed up to ``most`` characters; a longer sentence by its words, apart from the others."""
    pieces = []
    for n, sentence in enumerate(re.split(r"(?<=[.!?])\s+|\n+", re.sub("\r\n?", "\n", text).strip()), 1):
        pieces += [(n, word) for word in sentence.split(" ")] if len(sentence) > most else [(0, sentence)]
    packed, owner = [""], 0
    for own, piece in pieces:
        more = f"{packed[-1]} {piece}".strip()
        if own == owner and (not packed[-1] or len(more) <= most):
            packed[-1] = more
        else:
            packed.append(piece)
        owner = own
    return [p for p in packed if p]


def _join(parts: list[str]) -> str:
    return "\n\n".join(p for p in parts if p).strip()


def _atom(rows: list[dict], forced: str | None = None, text: str | None = None, fragment: int | None = None) -> dict:
    return {"rows": rows, "forced": forced, "text": _join([r["text"] or "" for r in rows]) if text is None else text, "fragment": fragment}


def atoms_of(rows: Iterator[dict], limits: Limits) -> Iterator[dict]:
    """The atoms of a unit's blocks in order; two blocks ahead and one atom back are held."""
    ahead: deque[dict] = deque()
    source, last = iter(rows), None

    def peek() -> dict | None:
        if not ahead and (r := next(source, None)) is not None:
            ahead.append(r)
        return ahead[0] if ahead else None

    same = lambda a, b: a["section_id"] == b["section_id"] and a["page"] == b["page"]
    while (row := peek()) is not None:
        ahead.popleft()
        kind, made = row["block_type"], None
        if kind == "paragraph" and len(row["text"] or "") > limits.hard and len(parts := fragments(row["text"], limits.hard)) > 1:
            made = [_atom([row], None, t, i) for i, t in enumerate(parts)]
        elif kind == "caption" and (n := peek()) and n["block_type"] in MAIN and same(row, n):
            made = [_atom([row, ahead.popleft()], MAIN[n["block_type"]])]
        elif kind in MAIN:
            group = [row]
            if (n := peek()) and n["block_type"] == "caption" and same(row, n):
                group.append(ahead.popleft())
            if (n := peek()) and n["block_type"] == "paragraph" and same(row, n) and len(_atom([*group, n])["text"]) <= limits.soft:
                group.append(ahead.popleft())
            if last and last["forced"] is None and len(last["rows"]) == 1 and last["rows"][0]["block_type"] in ("heading", "paragraph") and same(last["rows"][0], row) and len(_atom([*last["rows"], *group])["text"]) <= limits.soft:
                group, last = [*last["rows"], *group], None
            made = [_atom(group, MAIN[kind])]
        for a in made or [_atom([row], "list" if kind == "list_item" else None)]:
            if last:
                yield last
            last = a
    if last:
        yield last


def packs_of(atoms: Iterator[dict], limits: Limits) -> Iterator[tuple[list[dict], str | None, bool]]:
    """``atoms, forced type, whole unit`` of each chunk of a unit; a small unit of no table, figure or formula is one chunk."""
    held: list[dict] = []
    size, source, small = 0, iter(atoms), True
    for a in source:
        held.append(a)
        size += len(a["text"]) + 2 * bool(a["text"])
        if a["forced"] in MAIN.values() or size - 2 > limits.soft:
            small = False
            break
    if small:
        if held:
            yield held, None, True
        return

    def packed(run: Iterator[dict]) -> Iterator[list[dict]]:
        text = lambda p: _join([a["text"] for a in p])
        before, now, now_text = None, [], ""
        for a in run:
            more = _join([now_text, a["text"]])
            if now and len(more) > limits.soft and (len(now_text) >= limits.least or len(more) > limits.hard):
                if before:
                    yield before
                before, now, now_text = now, [a], a["text"].strip()
            else:
                now.append(a)
                now_text = more
        if before and len(now_text) < limits.least and len(text([*before, *now])) <= limits.soft:
            yield [*before, *now]
        else:
            if before:
                yield before
            yield now

    def rest() -> Iterator[dict]:
        yield from held
        yield from source

    for n, (forced, run) in enumerate(groupby(enumerate(rest()), lambda x: x[1]["forced"] if x[1]["forced"] in (None, "list") else x[0])):
        if forced is None or forced == "list":
            for p in packed(a for _, a in run):
                yield p, forced, False
        else:
            yield [a := next(run)[1]], a["forced"], False


#: Fixed value: what a chunk over the hard limit that can't be cut is warned of.
OVERSIZE = "atomic_oversize"


def build(ordered: DataFrame, openings: DataFrame, texts: DataFrame, sections: DataFrame, limits: Limits) -> DataFrame:
    """``document_id, chunk_index, chunk_id, chunk_type, unit, section_id, path, confidence, blocks, text, text_hash, location_type, first_page, last_page, warnings`` of every chunk.

    ``ordered``: blocks with ``ordinal`` and ``has_text`` and without repeated
    furniture; ``openings``: ``document_id, block_id`` of the first block of
    each document, furniture or not; ``texts``: ``document_id, block_id, text``; ``sections``: ``document_id,
    section_id, level, path`` (titles from the root). A chunk's path is that of
    its section; its structure is ``canonical`` if it has one, else ``weak``. Blocks stream through Python unit by unit; what is
    held is bounded by the limits, but for blocks without text.
    """
    head = F.col("block_type").isin("title", "heading")
    u = running(structural_units(ordered), ["document_id"], "ordinal", head.cast("int"), "heads")
    units = cut_lineage(u.select("document_id", "block_id", "ordinal", "block_type", "page", "section_id", "location_type", "scope", F.col("unit").cast("bigint").alias("unit"), "heads", "has_text"))
    named = units.filter(head).select("document_id", "heads", F.col("has_text").alias("named"))
    start = openings.select("document_id", F.col("block_id").alias("opening"))
    rows = units.join(named, ["document_id", "heads"], "left").join(start, "document_id", "left").withColumn("start", F.col("opening") == F.col("block_id")).drop("heads", "has_text", "opening").join(texts.select("document_id", "block_id", "text"), ["document_id", "block_id"], "left")
    schema = rows.sparkSession.createDataFrame([], _MADE).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        every = (r for b in batches for s in range(0, b.num_rows, 500) for r in b.slice(s, 500).to_pylist())
        types = pa.schema([("document_id", pa.string()), ("unit", pa.int64()), ("pack", pa.int64()), ("forced", pa.string()), ("first", pa.bool_()), ("titled", pa.bool_()), ("preamble", pa.bool_()), ("scope", pa.string()), ("section_id", pa.string()), ("blocks", pa.list_(pa.string())), ("fragment", pa.int32()), ("text", pa.string()), ("first_page", pa.int32()), ("last_page", pa.int32()), ("indivisible", pa.bool_()), ("location_type", pa.string())])
        for (doc, unit), own in groupby(every, lambda r: (r["document_id"], r["unit"])):
            for n, (p, forced, _) in enumerate(packs_of(atoms_of(own, limits), limits)):
                blocks = [r for a in p for r in a["rows"]]
                lead, pages = blocks[0], [r["page"] for r in blocks if r["page"] is not None]
                frag = [a["fragment"] for a in p if a["fragment"] is not None]
                out.append({
                    "document_id": doc, "unit": unit, "pack": n, "forced": forced, "first": n == 0, "scope": lead["scope"], "section_id": lead["section_id"],
                    "titled": any(r["block_type"] in ("title", "heading") and r["text"] is not None for r in blocks) or bool(n == 0 and lead["block_type"] not in ("title", "heading") and (lead["scope"] or "").startswith("provisional-") and lead["named"]),
                    "preamble": any(r["start"] for r in blocks) and any(r["block_type"] == "title" for r in blocks),
                    "blocks": list(dict.fromkeys(r["block_id"] for r in blocks)), "fragment": frag[-1] if frag else None, "text": _join([a["text"] for a in p]), "first_page": min(pages, default=None), "last_page": max(pages, default=None),
                    "indivisible": len(p) == 1 and (p[0]["forced"] is not None or len(p[0]["rows"]) == 1), "location_type": lead["location_type"],
                })
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, types)
                    out = []
        yield pa.RecordBatch.from_pylist(out, types)

    made = cut_lineage(rows.repartition("document_id", "unit").sortWithinPartitions("document_id", "unit", "ordinal").mapInArrow(run, schema))
    titled = made.groupBy("document_id", "unit").agg(F.max("titled").alias("titled"))
    made = made.drop("titled").join(titled, ["document_id", "unit"]).join(sections.select("document_id", "section_id", "level", "path"), ["document_id", "section_id"], "left")
    plain = F.when(F.col("section_id").isNotNull(), F.when(F.col("level") == 1, "section").otherwise("subsection")).when(F.col("preamble"), "document_preamble").when(F.col("titled"), "section").otherwise("orphan_content")
    typed = made.withColumn("chunk_type", F.coalesce("forced", F.when(F.col("first"), plain).otherwise("paragraph_group")))
    n = number(typed.drop("text"), ["document_id"], ["unit"], ["pack"], "chunk_index").withColumn("chunk_index", F.col("chunk_index") - 1)

    def ids(doc: pd.Series, section: pd.Series, blocks: pd.Series, kind: pd.Series, index: pd.Series, frag: pd.Series) -> pd.Series:
        made = [json.dumps({"schema": SCHEMA, "document": d, "section": s, "blocks": list(b), "type": k, "stable_index": int(i), "fragment": None if pd.isna(f) else int(f)}, sort_keys=True, separators=(",", ":")) for d, s, b, k, i, f in zip(doc, section, blocks, kind, index, frag)]
        return pd.Series([sha256(x.encode()).hexdigest() for x in made])

    made_id = F.pandas_udf(ids, "string")("document_id", "scope", "blocks", "chunk_type", "chunk_index", "fragment")
    return n.withColumn("chunk_id", made_id).join(made.select("document_id", "unit", "pack", "text"), ["document_id", "unit", "pack"]).select(
        "document_id", "chunk_index", "chunk_id", "chunk_type", "unit", "section_id", "path", F.when(F.col("section_id").isNull(), "weak").otherwise("canonical").alias("confidence"), "blocks", "text", X.text_hash(F.col("text")).alias("text_hash"), "location_type", "first_page", "last_page",
        F.array_compact(F.array(F.when(F.col("indivisible") & (F.length("text") > limits.hard), F.lit(OVERSIZE)))).alias("warnings"),
    )
