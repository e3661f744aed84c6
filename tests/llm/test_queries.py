from __future__ import annotations

import os

import pytest

from lectern.llm import tokens
from lectern.llm.oracle import oracle_sql
from lectern.llm.queries import queries
from tests.oracle import connect, rows_of, rows_of_sql

COLUMNS = {
    "p1_found": ["document_id", "transformation_id", "defect"], "p2_found": ["document_id", "item_id", "noise"], "p3_found": ["document_id", "chunk_id"], "p4_found": ["document_id", "block_id", "line_no"], "p6_found": ["document_id", "block_id"], "p8_ids": ["doc_id", "ids"],
    "p10_found": ["doc_id", "reading_level"],
}

NEEDS_TOKENS = ("p7_", "p8_", "p9_")


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, folder, name):
    if name.startswith(NEEDS_TOKENS) and not os.path.exists(tokens.RANKS):
        pytest.skip("no tokenizer files here")
    df = queries()[name](spark, folder)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    columns, rows = rows_of(df)
    assert rows
    if name in oracle_sql():
        assert (columns, rows) == rows_of_sql(connect(folder), oracle_sql()[name])
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p4_found", "p9_selection"])
def test_partitions_do_not_matter(spark, folder, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(rows_of(queries()[name](spark, folder)))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
