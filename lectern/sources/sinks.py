"""Writers: once only, staged, split by status, JSON lines, Markdown."""

from __future__ import annotations

import json
import logging
import os
from datetime import UTC, datetime
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_roots(source: str, *outputs: str) -> None:
    """Refuse an output that lies in the source or in another output, before anything runs."""
    norm = [os.path.normpath(urlparse(p).path if "://" in p else p) for p in (source, *outputs)]
    for i, a in enumerate(norm):
        for b in norm[i + 1 :]:
            if a == b or a.startswith(b + os.sep) and norm.index(b) > 0 or b.startswith(a + os.sep):
                raise ValueError(f"{b} and {a} must not contain each other")


def write_once(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write to a path that must not exist. The committer makes it visible as a whole."""
    df.write.format(form).mode("errorifexists").save(path)


def write_verified(df: DataFrame, path: str, keys: list[str], checks: dict[str, Column], form: str = "parquet") -> None:
    """Write to a staging path, read back, check, then move into place.

    ``checks`` maps names to conditions that every row must fulfil; ``keys``
    must be unique. A failed check leaves the staging path for inspection and
    nothing at ``path``.
    """
    spark, staging = df.sparkSession, path.rstrip("/") + ".staging"
    df.write.format(form).mode("overwrite").save(staging)
    back = spark.read.format(form).schema(df.schema).load(staging)
    bad = [F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()]
    row = back.agg(F.count(F.lit(1)).alias("_rows"), *bad).first()
    failed = {n: row[n] for n in checks if row[n]}
    repeated = back.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    if failed or repeated:
        raise ValueError(f"not written to {path}: {failed or 'keys are repeated'}")
    _move(df, staging, path)


def _move(df: DataFrame, staging: str, path: str) -> None:
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs  # noqa: SLF001
    source, target = hadoop.Path(staging), hadoop.Path(path)
    system = source.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    if system.exists(target) or not system.rename(source, target):
        raise ValueError(f"{path} exists or cannot be made")


def write_equal(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write once and read back: what stands there must equal ``df`` as a bag of rows, or it is not moved into place."""
    staging = path.rstrip("/") + ".staging"
    df.write.format(form).mode("overwrite").save(staging)
    back = df.sparkSession.read.format(form).schema(df.schema).load(staging)
    if df.exceptAll(back).limit(1).count() or back.exceptAll(df).limit(1).count():
        raise ValueError(f"not written to {path}: the rows read back differ")
    _move(df, staging, path)


def append_failures(df: DataFrame, path: str) -> None:
    """Failures are only ever added to, as JSON lines with the time of writing."""
    df.withColumn("recorded_at", F.current_timestamp()).write.mode("append").json(path)


def write_json_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """One JSON object a line, ranges of the order in the order of files; read back, the lines must stand in that order."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("errorifexists").text(path)
    names = [df.schema[c] for c in order]
    key = F.struct(*[F.get_json_object("value", f"$.{c.name}").cast(c.dataType).alias(c.name) for c in names])
    back = df.sparkSession.read.text(path).select(key.alias("k"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    before = F.lag("k").over(Window.partitionBy("file").orderBy("at"))
    if back.withColumn("before", before).filter("before > k").limit(1).count():
        raise ValueError(f"lines of {path} are out of order")


def write_dataset(documents: DataFrame, chunks: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """One JSON object for each document with its chunks in order (``document_id, chunk_index``), written once."""
    rest = [c for c in chunks.columns if c != "document_id"]
    own = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", *[c for c in rest if c != "chunk_index"]))).alias("chunks"))
    whole = documents.join(own, "document_id", "left").withColumn("chunk_count", F.coalesce(F.size("chunks"), F.lit(0)))
    whole.select(F.to_json(F.struct(*(keys or whole.columns))).alias("value")).write.mode("errorifexists").text(path)


def write_accepted(batches: list[DataFrame], path: str, status: str = "status") -> int:
    """The accepted rows of all batches as JSON lines at a path that must not exist; their number."""
    from lectern.operators.auditing import accepted

    rows = accepted(*batches, status=status)
    rows.write.mode("errorifexists").json(path)
    return rows.count()


def write_library(inventory: DataFrame, path: str) -> None:
    """An inventory as JSON and CSV, and the reports derived from it: duplicates, errors, unsupported files.

    ``inventory``: ``path, sha256, status, error`` and more; all reports are
    filters of the one inventory, written below ``path``.
    """
    copies = inventory.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1 and sha256 is not null")
    parts = {"inventory": inventory, "duplicates": inventory.join(copies, "sha256"), "errors": inventory.filter("error is not null"), "unsupported": inventory.filter(F.col("status") == "unsupported")}
    for name, df in parts.items():
        write_once(df, f"{path}/{name}.json", "json")
    write_csv(inventory, f"{path}/inventory.csv")


class JsonLines(logging.Formatter):
    """A log record as one JSON object a line: time in UTC, level, logger, message and, if there is one, the exception."""

    def format(self, record: logging.LogRecord) -> str:
        line = {"timestamp": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        return json.dumps(line | ({"exception": self.formatException(record.exc_info)} if record.exc_info else {}), ensure_ascii=False)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns as JSON."""
    flat = [F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f.name) for f in df.schema]
    df.select(*flat).write.option("header", "true").mode("errorifexists").csv(path)


def write_by_status(df: DataFrame, path: str, status: str = "status") -> None:
    """One folder for each status, written in one pass."""
    df.write.partitionBy(status).mode("errorifexists").parquet(path)


def markdown(blocks: DataFrame) -> DataFrame:
    """``document_id, markdown``: titles, pages as ``##``, headings as ``###``, list items as ``-``; ``blocks`` need ``ordinal``."""
    t = F.trim(F.coalesce("text", F.lit("")))
    line = F.when(F.col("block_type") == "title", F.concat(F.lit("# "), t)).when(F.col("block_type") == "heading", F.concat(F.lit("### "), t)).when(F.col("block_type") == "list_item", F.concat(F.lit("- "), t)).otherwise(t)
    pages = blocks.filter(t != "").withColumn("line", line).groupBy("document_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]), "\n\n").alias("body"))
    head = F.when(F.col("page").isNull(), F.col("body")).otherwise(F.concat(F.lit("## Page "), F.col("page"), F.lit("\n\n"), F.col("body")))
    return pages.withColumn("body", head).groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "body"))), lambda x: x["body"]), "\n\n").alias("markdown"))


def chunks_markdown(chunks: DataFrame) -> DataFrame:
    """``document_id, markdown``: every chunk of a document under its title path and location; ``chunks``: ``document_id, chunk_index, chunk_type, path, first_page, last_page, text``."""
    head = F.concat(F.lit("## "), F.coalesce(F.array_join("path", " / "), F.lit("")), F.lit(" ("), F.coalesce("chunk_type", F.lit("chunk")), F.lit(", "), location_label(F.col("first_page"), F.col("last_page")), F.lit(")"))
    body = F.concat_ws("\n\n", head, F.trim(F.coalesce("text", F.lit(""))))
    return chunks.withColumn("body", body).groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "body"))), lambda x: x["body"]), "\n\n").alias("markdown"))


def location_label(first: Column, last: Column) -> Column:
    """``page 3``, ``pages 3-5``, ``document``."""
    return F.when(first.isNull(), "document").when(first == last, F.concat(F.lit("page "), first)).otherwise(F.concat(F.lit("pages "), first, F.lit("-"), last))
