"""Inventories of files: duplicates, routes, selections, manifests, differences, target paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a file is by its extension.
FILE_TYPES = {
    "pdf": "PDF", "docx": "Microsoft Word", "doc": "Microsoft Word", "pptx": "Microsoft PowerPoint", "ppt": "Microsoft PowerPoint", "xlsx": "Microsoft Excel", "xls": "Microsoft Excel", "odt": "OpenDocument Text", "odp": "OpenDocument Presentation", "epub": "EPUB",
    "md": "Markdown", "html": "HTML", "htm": "HTML", "txt": "Plain Text", "rtf": "Rich Text", "png": "PNG image", "jpg": "JPEG image", "jpeg": "JPEG image", "tif": "TIFF image", "tiff": "TIFF image", "bmp": "BMP image", "webp": "WEBP image",
}


def extension(path: Column) -> Column:
    """The extension of a path in lower case without its dot; empty if it has none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def file_type(path: Column) -> Column:
    """What a file is by its extension, ``Unknown`` for others."""
    known = F.create_map(*[F.lit(v) for x in FILE_TYPES.items() for v in x])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("Unknown"))


def glob(pattern: str) -> str:
    """The regular expression of a shell pattern in which ``*`` matches slashes too."""
    import fnmatch

    return fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$")


def duplicates(files: DataFrame, content: str, name: str) -> DataFrame:
    """``content, copies, first_name, name``: a row for every name of a content that stands under several.

    Counts and first names are taken by an aggregate with map-side combination
    and joined back, so a content with a third of all names is never gathered
    in one value. Null contents are no content; a name listed twice counts twice.
    """
    known = files.filter(F.col(content).isNotNull()).select(content, name)
    total = known.groupBy(content).agg(F.count(F.lit(1)).alias("copies"), F.min(name).alias("first_name")).filter("copies > 1")
    return known.join(total, content).select(content, "copies", "first_name", name)


def included(files: DataFrame, path: str, size: str, extensions: list[str], excluded: list[str], most: int) -> DataFrame:
    """Files of a listed extension whose path matches no excluded pattern and whose size is at most ``most``; null paths and sizes are left out."""
    keep = extension(F.col(path)).isin(extensions) & (F.col(size) <= most)
    for pattern in excluded:
        keep = keep & ~F.col(path).rlike(glob(pattern))
    return files.filter(keep)


def representatives(files: DataFrame, category: Column, order: list[str], most: int) -> DataFrame:
    """The first file of each category, then the first others, ``most`` in all.

    The first of a category is an aggregate; the rest a top-k, so neither sorts
    all files in one task. Files whose category is null only fill up.
    """
    key = F.struct(*order)
    f = files.withColumn("_c", category)
    first = f.filter("_c is not null").groupBy("_c").agg(F.min(key).alias("_k")).withColumn("_first", F.lit(0))
    ranked = f.withColumn("_k", key).join(first.select("_k", "_first"), "_k", "left").withColumn("_first", F.coalesce("_first", F.lit(1)))
    return ranked.orderBy("_first", "_k").limit(most).drop("_c", "_k", "_first")


def reuse(live: DataFrame, cached: DataFrame, key: str, same: list[str]) -> DataFrame:
    """``live`` with ``state``: ``current`` if the cached row of the key agrees in all ``same`` columns, ``stale`` if it differs, ``new`` if there is none."""
    c = cached.select(F.col(key).alias("_key"), *[F.col(s).alias(f"_{s}") for s in same], F.lit(True).alias("_there"))
    agree = F.lit(True)
    for s in same:
        agree = agree & live[s].eqNullSafe(c[f"_{s}"])
    state = F.when(c["_there"].isNull(), "new").when(agree, "current").otherwise("stale")
    return live.join(c, live[key] == c["_key"], "left").select(*[live[x] for x in live.columns if x != "state"], state.alias("state"))


def changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """``key, change``: ``added``, ``removed`` or ``modified`` between two snapshots with one row per key; equal rows are left out. Null values are equal."""
    b = before.select(F.col(key).alias("_b"), F.col(value).alias("_v"))
    a = after.select(F.col(key).alias("_a"), F.col(value).alias("_w"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("_v").eqNullSafe(F.col("_w")), "modified")
    return b.join(a, b["_b"] == a["_a"], "full").select(F.coalesce("_a", "_b").alias(key), change.alias("change")).filter("change is not null")


def target_paths(files: DataFrame, path: str, content: str) -> DataFrame:
    """``path, target``: the text file of each source, unique: ``name.txt``, else ``name__ext.txt``, else with 12 characters of the content's hash, else null.

    A name is decided by how many sources propose it, counted by aggregates on
    the proposal; no order of the sources matters.
    """
    stem, ext = F.regexp_replace(path, r"\.[^./\\]+$", ""), extension(F.col(path))
    f = files.select(path, F.concat(stem, F.lit(".txt")).alias("_1"), F.concat(stem, F.lit("__"), ext, F.lit(".txt")).alias("_2"), F.concat(stem, F.lit("__"), ext, F.lit("__"), F.substring(F.col(content), 1, 12), F.lit(".txt")).alias("_3"))
    alone = f
    for k in ("_1", "_2", "_3"):
        n = f.groupBy(F.lower(k).alias(f"{k}k")).agg(F.count(F.lit(1)).alias(f"{k}n"))
        alone = alone.join(n, F.lower(alone[k]) == n[f"{k}k"], "left")
    return alone.select(path, F.when(F.col("_1n") == 1, F.col("_1")).when(F.col("_2n") == 1, F.col("_2")).when(F.col("_3n") == 1, F.col("_3")).alias("target"))


def scan_metrics(pages: DataFrame) -> DataFrame:
    """``document_id, pages, before, after, low_pages, gain, outcome`` from ``document_id, page, before, after`` (characters of each page, null where there is no such page).

    ``gain`` is in per cent, null where there was nothing before. Pages that
    only one side has make a result ``invalid``. One that keeps less than nine
    tenths is ``degraded``, one that gains less than 50 characters and less
    than a quarter ``no_material_improvement``; else it is ``accepted``, with
    warnings if a page of under 100 characters is left.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    p = pages.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(n("before")).alias("before"), F.sum(n("after")).alias("after"), F.count_if(n("before") < 100).alias("low_pages"), F.count_if(n("after") < 100).alias("_low_after"), F.count_if(F.col("before").isNull() | F.col("after").isNull()).alias("_odd"),
    )
    gain = F.try_divide((F.col("after") - F.col("before")) * F.lit(100.0), F.col("before").cast("double"))
    outcome = F.when(F.col("_odd") > 0, "invalid").when(F.col("after") < 0.9 * F.col("before"), "degraded").when((F.col("after") - F.col("before") < 50) & (F.coalesce(gain, F.lit(0.0)) < 25), "no_material_improvement").when(F.col("_low_after") > 0, "accepted_with_warnings").otherwise("accepted")
    return p.select("document_id", "pages", "before", "after", "low_pages", F.round(gain, 4).alias("gain"), outcome.alias("outcome"))


def lowest(rows: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """``keys, ident, choices``: the smallest id of each key and how many there were to choose from; more than one is worth a warning."""
    return rows.groupBy(*keys).agg(F.min(ident).alias(ident), F.countDistinct(ident).alias("choices"))


def samples(files: DataFrame, kind: Column, size: str, order: list[str], most: int) -> DataFrame:
    """A small sample of every kind: the smallest file of each, then the smallest others, ``most`` in all; null sizes come last."""
    return representatives(files.withColumn("_size", F.coalesce(F.col(size), F.lit(2**31 - 1))), kind, ["_size", *order], most).drop("_size")


def thirds(n: Column) -> Column:
    """``struct<easy, medium, hard>``: n in three parts, the remainder to medium, then to easy."""
    part, rest = F.floor(n / 3), n % 3
    return F.struct((part + (rest >= 2).cast("int")).alias("easy"), (part + (rest >= 1).cast("int")).alias("medium"), part.alias("hard"))
