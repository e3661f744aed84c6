from __future__ import annotations

import hashlib
import json
import logging

import pytest
from pyspark.sql import functions as F

from lectern.sources import exports, files, sinks, tables
from lectern.sources.tables import latest, latest_texts
from lectern.streaming import incremental


def test_discovery(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "Pôle B" / "x").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"same")
    (root / "Pôle B" / "b.TXT").write_bytes(b"same")
    (root / "Pôle B" / "x" / "c").write_bytes(b"z")
    (root / "empty").write_bytes(b"")
    (root / "_under").write_bytes(b"u")
    (root / ".dot").write_bytes(b"")
    (root / "link").symlink_to(root / "a.txt")
    got = {r.path: r for r in files.discover(spark, str(root)).collect()}
    assert set(got) == {"a.txt", "Pôle B/b.TXT", "Pôle B/x/c", "empty", "_under", ".dot"}
    assert got["empty"].sha256 == hashlib.sha256(b"").hexdigest() and got["_under"].size == 1 and all(r.error is None for r in got.values())
    assert {r.directory: r.files for r in files.directories(files.discover(spark, str(root))).collect()} == {"Pôle B": 2, "Pôle B/x": 1}
    assert [r.path for r in files.discover(spark, str(root), "*.txt").collect()] == ["a.txt"]
    (tmp_path / "none").mkdir()
    assert files.discover(spark, str(tmp_path / "none")).count() == 0
    assert got["a.txt"].sha256 == hashlib.sha256(b"same").hexdigest() and got["a.txt"].file_type == "Plain Text"
    assert got["Pôle B/b.TXT"].extension == "txt" and got["Pôle B/x/c"].file_type == "Unknown" and got["Pôle B/x/c"].size == 1


def test_decoding(spark):
    cases = ["é".encode(), "é".encode("utf-8-sig"), "é".encode("utf-16"), "é".encode("utf-32"), b"\xff\xff", b"", None]
    df = spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, c in enumerate(cases)], "i int, content binary")
    got = {r.i: r.d for r in df.select("i", files.decoded(F.col("content")).alias("d")).collect()}
    assert [got[i].text for i in range(7)] == ["é", "é", "é", "é", None, "", None]
    assert got[4].error == "invalid_encoding" and got[6].error is None and got[3].encoding == "UTF-32"


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n[1]\n{"a": 2, "z": 0}\n')
    got = [(r.line_no, r.error, r.a) for r in files.read_json_rows(spark, str(tmp_path / "x.jsonl"), "a int").orderBy("line_no").collect()]
    assert got == [(1, None, 1), (2, "blank", None), (3, "not_an_object", None), (4, "unknown_field", 2)]


def test_exports_round_trip(spark):
    docs = spark.createDataFrame([("d", "x/y.pdf", "Titel\nzwei"), ("e", "z.docx", None)], "document_id string, source_path string, title string")
    blocks = spark.createDataFrame([("d", "page", 2, 0, "b1"), ("d", "page", 1, 1, "a2\nzeile"), ("d", "page", 1, 0, " a1 "), ("d", "page", 1, 2, None), ("d", "page", 3, 0, " ")], "document_id string, location_type string, page int, place int, text string")
    out = exports.render(docs, blocks)
    parsed = out.select(F.col("document_id").alias("path"), "text", exports.parse_header(F.col("text")).alias("h")).cache()
    rows = {r.path: r for r in parsed.collect()}
    assert rows["d"].h.error is None and rows["d"].h.header["TITLE"] == "Titel zwei" and rows["d"].h.header["LOCATIONS"] == "2" and rows["e"].h.body == "\n"
    parts = exports.locations(parsed.select("path", F.col("h.body").alias("body"), F.col("h.body_start").alias("body_start"))).cache()
    for r in parts.collect():
        assert rows[r.path].text[r.start : r.end] == r.text
    got = {(r.path, r.location_no): (r.kind, r.number) for r in parts.collect() if r.kind}
    assert got == {("d", 1): ("PAGE", 1), ("d", 2): ("PAGE", 2)}
    made = exports.location_blocks(parts).collect()
    assert sorted((r.location_no, r.block_no, r.text) for r in made) == [(1, 1, "a1"), (1, 2, "a2\nzeile"), (2, 1, "b1")]
    for r in made:
        assert rows[r.path].text[r.start : r.end] == r.text
    broken = spark.createDataFrame([("SOURCE PATH: x\nWRONG: y",)], "text string").select(exports.parse_header(F.col("text")).alias("h")).first().h
    assert broken.error == "SOURCE SHA256"


def test_text_before_marks_and_page_numbers(spark):
    bodies = [("a", "===== PAGE 1 =====\n\nx\n===== PAGE 2 =====\ny"), ("b", "verloren\n===== PAGE 1 =====\nx"), ("c", "===== PAGE 2 =====\nx"), ("d", "===== DOCUMENT CONTENT =====\nx"), ("e", ""), ("f", "nur Text")]
    parts = exports.locations(spark.createDataFrame(bodies, "path string, body string").withColumn("body_start", F.lit(0))).cache()
    assert {(r.path, r.location_no, r.error) for r in parts.filter("error is not null").collect()} == {("b", 0, "text_before_first_mark"), ("f", 0, "text_before_first_mark")}
    assert {r.path: r.holds for r in exports.page_numbers_hold(parts).collect()} == {"a": True, "b": False, "c": False, "d": True, "f": False}
    for r in parts.collect():
        assert dict(bodies)[r.path][r.start : r.end] == r.text


def test_more_writers(spark, tmp_path):
    df = spark.createDataFrame([("d", 1, "x", "accepted"), ("d", 0, "y", "rejected")], "document_id string, chunk_index int, text string, status string")
    sinks.write_equal(df, str(tmp_path / "equal"))
    assert spark.read.parquet(str(tmp_path / "equal")).count() == 2
    for _ in range(2):
        sinks.append_failures(df, str(tmp_path / "failures"))
    assert spark.read.json(str(tmp_path / "failures")).count() == 4
    sinks.write_dataset(spark.createDataFrame([("d", "t"), ("e", None)], "document_id string, title string"), df.drop("status"), str(tmp_path / "data"))
    made = {r["document_id"]: r for r in map(json.loads, (r.value for r in spark.read.text(str(tmp_path / "data")).collect()))}
    assert [c["text"] for c in made["d"]["chunks"]] == ["y", "x"] and made["e"]["chunk_count"] == 0
    assert sinks.write_accepted([df, df], str(tmp_path / "bank")) == 2
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_accepted([df], str(tmp_path / "bank"))
    inventory = spark.createDataFrame([("a", "h", "ok", None), ("b", "h", "unsupported", None), ("c", None, "unreadable", "bad")], "path string, sha256 string, status string, error string")
    sinks.write_library(inventory, str(tmp_path / "library"))
    count = lambda n: spark.read.json(str(tmp_path / "library" / f"{n}.json")).count()
    assert [count(n) for n in ("inventory", "duplicates", "errors", "unsupported")] == [3, 2, 1, 1]
    chunks = spark.createDataFrame([("d", 0, "list", ["A", "B"], 1, 2, " x ")], "document_id string, chunk_index int, chunk_type string, path array<string>, first_page int, last_page int, text string")
    assert sinks.chunks_markdown(chunks).first().markdown == "## A / B (list, pages 1-2)\n\nx"
    record = logging.LogRecord("n", logging.INFO, "f", 1, "Größe %d", (3,), None)
    line = json.loads(sinks.JsonLines().format(record))
    assert line["message"] == "Größe 3" and line["level"] == "INFO" and line["timestamp"].endswith("+00:00")


def test_roots_must_be_apart():
    sinks.check_roots("/a/b", "/a/c", "/d")
    for bad in (("/a", "/a/b"), ("/a", "/a"), ("/a", "/b", "/b/c")):
        with pytest.raises(ValueError):
            sinks.check_roots(*bad)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", ["x"]), (1, "a", None)], "id int, status string, tags array<string>")
    sinks.write_once(df, str(tmp_path / "once"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_once(df, str(tmp_path / "once"))
    sinks.write_verified(df, str(tmp_path / "good"), ["id"], {"positive": F.col("id") > 0})
    assert spark.read.parquet(str(tmp_path / "good")).count() == 2
    with pytest.raises(ValueError):
        sinks.write_verified(df, str(tmp_path / "bad"), ["id"], {"large": F.col("id") > 1})
    with pytest.raises(ValueError):
        sinks.write_verified(df.union(df), str(tmp_path / "twice"), ["id"], {})
    assert not (tmp_path / "bad").exists()
    sinks.write_json_lines(df, str(tmp_path / "lines"), ["id"])
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()][0].startswith('{"id":1')
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).filter("id = 2").first().tags == '["x"]'
    sinks.write_by_status(df, str(tmp_path / "by"))
    assert spark.read.parquet(str(tmp_path / "by")).filter("status = 'a'").count() == 1


def test_markdown_and_labels(spark):
    b = spark.createDataFrame([("d", 1, 1, "title", "T"), ("d", 1, 2, "list_item", "x"), ("d", 2, 3, "heading", "H"), ("d", 2, 4, "paragraph", None)], "document_id string, page int, ordinal int, block_type string, text string")
    assert sinks.markdown(b).first().markdown == "## Page 1\n\n# T\n\n- x\n\n## Page 2\n\n### H"
    p = spark.createDataFrame([(None, None), (3, 3), (3, 5)], "a int, b int").select(sinks.location_label(F.col("a"), F.col("b")).alias("l"))
    assert [r.l for r in p.collect()] == ["document", "page 3", "pages 3-5"]


def test_latest(spark, monkeypatch):
    rows = [("a", 1, "x", "k"), ("a", 2, "y", None), ("a", 2, "y", None), ("b", None, None, "k"), (None, 1, "n", "k")]
    df = spark.createDataFrame(rows, "id string, t int, v string, _row string")
    got = {r.id: (r.v, r._row) for r in latest(df, ["id"], "t").collect()}
    assert got == {"a": ("y", None), "b": (None, "k"), None: ("n", "k")}
    assert latest(df.limit(0), ["id"], "t", ["id", "v"]).columns == ["id", "v"]
    monkeypatch.setattr(tables, "REDELIVERED", 10)
    for most in (10, 0):
        monkeypatch.setattr(tables, "REDELIVERED", most)
        again = latest_texts(df, ["id"], "t")
        assert again.columns == ["id", "t", "v", "_row"] or set(again.columns) == {"id", "t", "v", "_row"}
        assert {r.id: (r.v, r._row) for r in again.collect()} == got
        assert latest_texts(df.limit(0), ["id"], "t", ["id", "v"]).columns == ["id", "v"]


def test_stream_takes_each_content_once(spark, tmp_path):
    for i in range(2):
        spark.sql("select 'same' as text, timestamp'2024-01-01' as at union all select 'other', timestamp'2024-01-02'").write.mode("append").parquet(str(tmp_path / "in"))
    stream = incremental.once_per_content(incremental.landing(spark, str(tmp_path / "in"), "text string, at timestamp"), "text", "at")
    incremental.run_batches(stream, lambda d: d.select("text", "content_hash"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["other", "same"]
    counts = incremental.windowed_counts(incremental.landing(spark, str(tmp_path / "in"), "text string, at timestamp"), "at", "text", late="0 days")
    q = counts.writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.text, r.rows) for r in spark.table("counted").collect()} <= {("same", 2), ("other", 2)}
