"""Queries on the section trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.hierarchy import Hierarchy, hierarchy
from lectern.sources.tables import latest, table


def _sections(spark: SparkSession, folder: str) -> Hierarchy:
    rows = latest(table(spark, folder, "sections"), ["document_id", "section_id"], "ingested_at", ["document_id", "section_id", "parent_section_id", "title"])
    return hierarchy(rows, "document_id", "section_id", "parent_section_id", "title")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _sections(spark, folder).cycles.select("document_id", "section_id", F.col("cycle_id").alias("cycle_section_id"), "on_cycle")


def p5_paths(spark: SparkSession, folder: str) -> DataFrame:
    return _sections(spark, folder).paths().withColumn("path", F.array_join("path", " / ", "-"))


def p5_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return _sections(spark, folder).descendants()


QUERIES = {f.__name__: f for f in (p5_found, p5_paths, p5_descendants)}

_TREE = """WITH RECURSIVE s AS (
  SELECT document_id, section_id, arg_max(parent_section_id, ingested_at) AS p0, arg_max(title, ingested_at) AS title
  FROM (SELECT document_id, section_id, ingested_at, struct_pack(v := parent_section_id) AS parent_section_id, struct_pack(v := title) AS title FROM sections)
  GROUP BY 1, 2),
n AS (SELECT s.document_id, s.section_id, s.p0.v AS parent, s.title.v AS title, q.section_id IS NULL AS root
      FROM s LEFT JOIN s q ON q.document_id = s.document_id AND q.section_id = s.p0.v),
w AS (SELECT document_id, section_id, 0 AS depth, section_id AS root_id, [title] AS path, [section_id] AS ids FROM n WHERE root
      UNION ALL
      SELECT n.document_id, n.section_id, w.depth + 1, w.root_id, list_append(w.path, n.title), list_append(w.ids, n.section_id)
      FROM n JOIN w ON n.document_id = w.document_id AND n.parent = w.section_id WHERE NOT n.root)"""

SQL = {
    "p5_found": _TREE
    + """, loose AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.document_id = n.document_id AND w.section_id = n.section_id)),
c AS (SELECT document_id, section_id, parent AS cur, 1 AS k FROM loose
      UNION ALL
      SELECT c.document_id, c.section_id, l.parent, k + 1 FROM c JOIN loose l ON l.document_id = c.document_id AND l.section_id = c.cur WHERE k <= (SELECT max(n) FROM (SELECT count(*) AS n FROM loose GROUP BY document_id))),
onc AS (SELECT DISTINCT document_id, section_id FROM c WHERE cur = section_id),
r AS (SELECT c.document_id, c.section_id, min(c.cur) AS cycle_section_id FROM c JOIN onc ON onc.document_id = c.document_id AND onc.section_id = c.cur GROUP BY 1, 2)
SELECT r.document_id, r.section_id, r.cycle_section_id, CAST(onc.section_id IS NOT NULL AS INTEGER) AS on_cycle
FROM r LEFT JOIN onc ON onc.document_id = r.document_id AND onc.section_id = r.section_id""",
    "p5_paths": _TREE
    + """, d AS (SELECT document_id, section_id, count(*) - 1 AS n FROM (SELECT document_id, unnest(ids) AS section_id FROM w) GROUP BY 1, 2)
SELECT n.document_id, n.section_id, array_to_string(list_transform(w.path, lambda x: coalesce(x, '-')), ' / ') AS path, w.depth, w.root_id, d.n AS n_descendants
FROM n LEFT JOIN w USING (document_id, section_id) LEFT JOIN d USING (document_id, section_id)""",
    "p5_descendants": _TREE
    + """ SELECT document_id, ids[i] AS section_id, section_id AS descendant_id, CAST(len(ids) - i AS INTEGER) AS distance
FROM (SELECT document_id, section_id, ids, unnest(range(1, len(ids))) AS i FROM w)""",
}
