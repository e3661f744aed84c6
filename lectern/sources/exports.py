"""Text exports: nine header lines, a blank line, a body parted by location marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The header's keys in their order.
HEADER = ["SOURCE PATH", "SOURCE SHA256", "DOCUMENT TYPE", "TITLE", "LANGUAGE", "EXPORT STATUS", "EXTRACTION TOOL", "LOCATIONS", "EXPORTED AT"]

#: A line that begins a location.
MARK = r"^={3,} (PAGE|SLIDE|DOCUMENT CONTENT|SOURCE TEXT)(?: (\p{Nd}+))? ={3,}$"


def render(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """``document_id, text``: the export of every document.

    ``documents``: ``document_id`` and a column for each header key in lower
    case with underscores (missing ones are empty lines); ``blocks``:
    ``document_id, location_type, page, place, text``. Locations come in
    order, each with its mark; null and blank texts are left out. A page's
    blocks are gathered first, then the pages of a document, since the
    document's text is the row that is asked for.
    """
    kept = blocks.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: F.trim(x["text"])), "\n\n")
    pages = kept.groupBy("document_id", "location_type", "page").agg(rows.alias("body"))
    mark = F.when(F.col("page").isNull(), F.lit("===== DOCUMENT CONTENT =====")).otherwise(F.concat(F.lit("===== "), F.upper("location_type"), F.lit(" "), F.col("page"), F.lit(" =====")))
    whole = pages.withColumn("body", F.concat(mark, F.lit("\n\n"), F.col("body"))).groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "body"))), lambda x: x["body"]), "\n\n").alias("body"), F.count(F.lit(1)).alias("locations"))
    known = set(documents.columns)
    d = documents.join(whole, "document_id", "left").withColumns({"body": F.coalesce("body", F.lit("")), "_locations": F.coalesce("locations", F.lit(0))})
    value = lambda k: F.col("_locations").cast("string") if k == "LOCATIONS" else (F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\s+", " "), F.lit("")) if (c := k.lower().replace(" ", "_")) in known else F.lit(""))
    head = F.array_join(F.array(*[F.concat(F.lit(f"{k}: "), value(k)) for k in HEADER]), "\n")
    return d.select("document_id", F.concat(head, F.lit("\n\n"), F.col("body"), F.lit("\n")).alias("text"))


def parse_header(text: Column) -> Column:
    """``struct<header map, body, body_start, error>`` of an export; ``error`` names the first line that is not the expected key."""
    lines = F.slice(F.split(text, "\n"), 1, len(HEADER) + 1)
    wrong = F.array_compact(F.array(*[F.when(~F.coalesce(F.startswith(F.get(lines, F.lit(i)), F.lit(f"{k}: ")), F.lit(False)), F.lit(k)) for i, k in enumerate(HEADER)]))
    values = F.map_from_arrays(F.array(*[F.lit(k) for k in HEADER]), F.array(*[F.substring(F.coalesce(F.get(lines, F.lit(i)), F.lit("")), F.lit(len(k) + 3), F.length(text)) for i, k in enumerate(HEADER)]))
    start = F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(x) + 1)
    error = F.when(F.size(wrong) > 0, wrong[0]).when(F.get(lines, F.lit(len(HEADER))) != "", "BLANK LINE")
    return F.struct(values.alias("header"), F.substring(text, start + 1, F.length(text)).alias("body"), start.alias("body_start"), error.alias("error"))


def locations(exports: DataFrame) -> DataFrame:
    """``path, location_no, kind, number, start, end, text, error``: the parts of each body, with the place of their text in the whole export.

    ``exports``: ``path, body, body_start``. A body is cut at its marks inside
    its row (a row is one export, which is one text); places are sums of the
    lengths before, so the text between ``start`` and ``end`` of the export is
    ``text``. Text before the first mark, or without any, is location 0 with
    the error ``text_before_first_mark``; blank text there is none.
    """
    lines = F.split("body", "\n")
    flagged = F.transform(lines, lambda x: F.struct(x.alias("line"), x.rlike(MARK).alias("mark")))
    start = F.struct(F.array().cast("array<struct<mark:string,at:int,text:string>>").alias("done"), F.lit(None).cast("string").alias("mark"), F.lit(0).alias("at"), F.lit(0).alias("next"), F.array().cast("array<string>").alias("open"))
    closed = lambda a: F.array_append(a["done"], F.struct(a["mark"].alias("mark"), a["at"].alias("at"), F.array_join(a["open"], "\n").alias("text")))

    def step(a, x):
        after = a["next"] + F.length(x["line"]) + 1
        return F.struct(
            F.when(x["mark"], closed(a)).otherwise(a["done"]).alias("done"), F.when(x["mark"], x["line"]).otherwise(a["mark"]).alias("mark"), F.when(x["mark"], after).otherwise(a["at"]).alias("at"), after.alias("next"),
            F.when(x["mark"], F.array().cast("array<string>")).otherwise(F.array_append(a["open"], x["line"])).alias("open"),
        )

    parts = F.aggregate(flagged, start, step, closed)
    l = exports.select("path", "body_start", F.posexplode(parts).alias("location_no", "p"))  # noqa: E741
    kind, n = F.regexp_extract("p.mark", MARK, 1), F.regexp_extract("p.mark", MARK, 2)
    lost = F.when(F.col("p.mark").isNull() & (F.trim(F.regexp_replace("p.text", r"\s+", " ")) != ""), "text_before_first_mark")
    out = l.select("path", "location_no", kind.alias("kind"), F.nullif(n, F.lit("")).cast("int").alias("number"), (F.col("body_start") + F.col("p.at")).alias("start"), F.col("p.text").alias("text"), lost.alias("error"))
    return out.filter("location_no > 0 or error is not null").select("path", "location_no", "kind", "number", "start", (F.col("start") + F.length("text")).alias("end"), "text", "error")


def page_numbers_hold(parts: DataFrame) -> DataFrame:
    """``path, holds``: whether the pages or slides of an export are numbered 1, 2, ... in order, none missing; exports of other kinds hold with one location."""
    g = parts.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count("number").alias("numbered"), F.count_if(F.col("number") == F.col("location_no")).alias("right"), F.count("error").alias("errors"))
    return g.select("path", ((F.col("errors") == 0) & (((F.col("numbered") == 0) & (F.col("n") == 1)) | (F.col("right") == F.col("n")))).alias("holds"))


def location_blocks(parts: DataFrame) -> DataFrame:
    """``path, location_no, block_no, start, end, text``: the runs of lines between blank lines of each location, with their places in the export.

    Blocks are cut inside the row in one pass that carries the place, and only
    then exploded, so a row's work grows with its text.
    """
    flagged = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), (F.trim(F.regexp_replace(x, r"\s+", " ")) == "").alias("blank")))
    start = F.struct(F.array().cast("array<struct<at:int,text:string>>").alias("done"), F.lit(0).alias("at"), F.lit(0).alias("next"), F.array().cast("array<string>").alias("open"))
    closed = lambda a: F.when(F.size(a["open"]) > 0, F.array_append(a["done"], F.struct(a["at"].alias("at"), F.array_join(a["open"], "\n").alias("text")))).otherwise(a["done"])

    def step(a, x):
        fresh = F.size(a["open"]) == 0
        return F.struct(
            F.when(x["blank"], closed(a)).otherwise(a["done"]).alias("done"), F.when(~x["blank"] & fresh, a["next"]).otherwise(a["at"]).alias("at"), (a["next"] + F.length(x["line"]) + 1).alias("next"), F.when(x["blank"], F.array().cast("array<string>")).otherwise(F.array_append(a["open"], x["line"])).alias("open"),
        )

    b = parts.select("path", "location_no", "start", F.posexplode(F.aggregate(flagged, start, step, closed)).alias("at", "b"))
    return b.select("path", "location_no", (F.col("at") + 1).alias("block_no"), (F.col("start") + F.col("b.at")).alias("start"), (F.col("start") + F.col("b.at") + F.length("b.text")).alias("end"), F.col("b.text").alias("text"))
