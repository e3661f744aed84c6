"""Trees of files as tables: discovery, hashes, decoding, failures as rows."""

from __future__ import annotations

import fnmatch
import hashlib
import os
from collections.abc import Iterator
from datetime import datetime
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.inventory import extension, file_type


def _relative(root: str) -> Column:
    """The path of a file without the root's, which stands somewhere in its address."""
    base = F.lit(root.rstrip("/") + "/")
    return F.substring(F.col("path"), F.instr(F.col("path"), base) + F.length(base), F.length("path"))


_LISTED = "address string, size bigint, modified timestamp"


def _listing(spark: SparkSession, root: str, pattern: str | None) -> DataFrame:
    """``address, size, modified`` of every regular file below ``root``, whatever its name or size; symbolic links are no files of the tree.

    The driver asks the file system for the names, as for any table of files,
    and hands them on in slices.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs  # noqa: SLF001
    at = hadoop.Path(root)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)  # noqa: SLF001
    rows, out = [], spark.createDataFrame([], _LISTED)
    while found.hasNext():
        f = found.next()
        name = f.getPath().getName()
        address = f.getPath().toString()
        if f.isSymlink() or name.endswith(".crc") or (pattern and not fnmatch.fnmatchcase(name, pattern)) or os.path.islink(f.getPath().toUri().getPath()):
            continue
        rows.append((address, f.getLen(), datetime.fromtimestamp(f.getModificationTime() / 1000)))
        if len(rows) >= 100_000:
            out, rows = out.unionByName(spark.createDataFrame(rows, _LISTED)), []
    return out.unionByName(spark.createDataFrame(rows, _LISTED)) if rows else out


def discover(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """``path, filename, extension, file_type, size, sha256, modified, error``: every regular file below ``root``, by its path relative to it.

    Empty files and files whose names begin with ``_`` or ``.`` are listed like
    any other. Bytes are read by the executors, file by file, and only the hash
    leaves a task; a file that can't be read gives an error in its row, never a
    failure of the job. An empty folder gives no rows. Paths sort by bytes, as
    Spark compares strings.
    """
    listed = _listing(spark, root, pattern)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums, errors = [], []
            for address in b["address"]:
                digest, error = hashlib.sha256(), None
                try:
                    with open(urlparse(address).path if ":" in address else address, "rb") as f:
                        while block := f.read(1 << 20):
                            digest.update(block)
                except OSError as e:
                    error = type(e).__name__
                sums.append(None if error else digest.hexdigest())
                errors.append(error)
            yield b.assign(sha256=sums, error=errors)

    def by_spark(files: DataFrame) -> DataFrame:
        """On file systems that only Spark reads, it reads what its index admits; the rest come without a hash."""
        seen = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("address"), F.sha2("content", 256).alias("sha256"))
        empty = F.when(F.col("size") == 0, F.sha2(F.lit(""), 256))
        return files.join(seen, "address", "left").withColumn("sha256", F.coalesce("sha256", empty)).withColumn("error", F.when(F.col("sha256").isNull(), "not_read"))

    local = (urlparse(root).scheme or "file") == "file"
    whole = listed.repartition("address").mapInPandas(hashed, _LISTED + ", sha256 string, error string") if local else by_spark(listed)
    f = whole.withColumn("path", F.col("address")).withColumn("path", _relative(root))
    return f.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), extension(F.col("path")).alias("extension"), file_type(F.col("path")).alias("file_type"), "size", "sha256", "modified", "error")


def directories(files: DataFrame, path: str = "path") -> DataFrame:
    """``directory, files``: every folder that holds files, itself or below, and how many."""
    parts = F.split(F.col(path), "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return files.filter(F.size(parts) > 1).select(F.explode(ups).alias("directory")).groupBy("directory").agg(F.count(F.lit(1)).alias("files"))


def decoded(content: Column) -> Column:
    """``struct<text, encoding, error>`` of bytes: by their mark as UTF-8, UTF-32 or UTF-16 (tested in this order of length), else strictly UTF-8.

    Bytes that are no valid text give a null text and an error, never a
    failure of the job. Null content gives nulls.
    """
    head = F.hex(F.substring(content, 1, 4))
    utf8 = F.when(head.startswith("EFBBBF"), F.substring(content, F.lit(4), F.octet_length(content))).otherwise(content)
    wide = F.when(head.startswith("FFFE0000") | head.startswith("0000FEFF"), "UTF-32").when(head.startswith("FFFE") | head.startswith("FEFF"), "UTF-16")
    valid = F.is_valid_utf8(utf8.cast("string"))
    text = F.when(wide == "UTF-32", F.decode(content, "UTF-32")).when(wide == "UTF-16", F.decode(content, "UTF-16")).when(valid, utf8.cast("string"))
    clean = F.regexp_replace(text, "^﻿", "")
    return F.struct(clean.alias("text"), F.coalesce(wide, F.lit("UTF-8")).alias("encoding"), F.when(content.isNotNull() & text.isNull(), "invalid_encoding").alias("error"))


def read_texts(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """``path, sha256, text, encoding, error`` of every text file below ``root``."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return f.select(_relative(root).alias("path"), F.sha2("content", 256).alias("sha256"), decoded(F.col("content")).alias("d")).select("path", "sha256", "d.*")


def read_json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file of JSON lines with ``line_no`` (from 1) and ``error``: ``blank``, ``not_an_object``, ``unknown_field`` or null.

    Line numbers need whole files, so a file is one value and is split inside
    the task that reads it; many files spread over the cluster.
    """
    names = [c for c in spark.createDataFrame([], schema).columns]
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("at", "line"))
    keys = F.json_object_keys("line")
    error = F.when(F.trim("line") == "", "blank").when(keys.isNull(), "not_an_object").when(F.size(F.array_except(keys, F.array(*[F.lit(n) for n in names]))) > 0, "unknown_field")
    return lines.select((F.col("at") + 1).alias("line_no"), error.alias("error"), F.from_json("line", schema).alias("r")).select("line_no", "error", "r.*")
