from __future__ import annotations

import pytest

from lectern.plans import catalog
from tests.oracle import connect, rows_of, rows_of_sql


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_its_sql(spark, folder, name):
    columns, rows = rows_of(catalog.queries()[name](spark, folder))
    if name in catalog.oracle_sql():
        assert (columns, rows) == rows_of_sql(connect(folder), catalog.oracle_sql()[name])
    else:
        assert columns


@pytest.mark.parametrize("name", ["greedy_chunks", "structural_units", "p5_found", "near_duplicate_pairs"])
def test_partitions_do_not_matter(spark, folder, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(rows_of(catalog.queries()[name](spark, folder)))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_every_query_has_a_name_of_its_own():
    parts = [set(p.QUERIES) for p in catalog._PARTS]
    assert sum(map(len, parts)) == len(set().union(*parts))
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
