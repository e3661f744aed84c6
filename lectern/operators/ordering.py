"""Order-dependent steps that never put a whole group in one task.

A window over a document would send a document with a third of all rows to a
single task. These steps take a finer key first (a page, a stretch of
positions), work inside it, and carry totals across by a window over the much
smaller table of totals. The finer key is one struct column: it is never null,
whatever is null in it, so windows and joins on it are plain equalities and the
rows move once; totals are joined to rows that already lie right. Groups may be
null; a null group is a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in one stretch.
STRETCH = 4096


def number(df: DataFrame, group: list[str], coarse: list[str], order: list, into: str = "ordinal") -> DataFrame:
    """Rows of each group numbered from 1 by (``coarse``, ``order``) in ``into``.

    ``coarse`` are columns by which the group is sorted first and of which one
    value holds a moderate number of rows (a page). Nulls come first. Give an
    ``order`` that settles all ties, or tied rows are numbered anyhow.
    """
    place = F.struct(*group, *coarse)
    inside = df.withColumn("_at", place).withColumn("_in", F.row_number().over(Window.partitionBy("_at").orderBy(*order)))
    if not coarse:
        return inside.withColumn(into, F.col("_in").cast("bigint")).select(*[c for c in df.columns if c != into], into)
    sizes = df.groupBy(*group, *coarse).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(*coarse).rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(place.alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return inside.join(base, "_at").withColumn(into, (F.col("_base") + F.col("_in")).cast("bigint")).select(*[c for c in df.columns if c != into], into)


def _stretch(ordinal: str) -> Column:
    return F.floor(F.col(ordinal) / STRETCH)


def _with_edges(df: DataFrame, group: list[str], ordinal: str, width: int) -> DataFrame:
    """``df`` by stretches (``_at``), the ``width`` rows on either side of each stretch lent to it (``_lent``)."""
    own, place = _stretch(ordinal), F.pmod(F.col(ordinal), F.lit(STRETCH))
    homes = F.array_compact(F.array(own, F.when(place < width, own - 1), F.when(place >= STRETCH - width, own + 1)))
    lent = df.withColumn("_home", F.explode(homes)).withColumn("_lent", F.col("_home") != own)
    return lent.withColumn("_at", F.struct(*group, "_home")).drop("_home")


def _seen(column: str, ordinal: str, step: int) -> Column:
    """The value of ``column`` exactly ``step`` positions further within ``_at``."""
    at = Window.partitionBy("_at").orderBy(ordinal)
    there = lambda c: F.lead(c, step).over(at) if step > 0 else F.lag(c, -step).over(at)
    return F.when(there(ordinal) == F.col(ordinal) + step, there(column))


def neighbours(df: DataFrame, group: list[str], ordinal: str, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """``df`` with each new column of ``wanted`` (new name to source and step): the source's value so many positions further; null where there is none.

    Rows move once, by (group, stretch), however many neighbours are asked
    for; the few rows at the edges of a stretch are lent to the next one.
    """
    lent = _with_edges(df, group, ordinal, max(abs(step) for _, step in wanted.values()))
    with_all = lent.withColumns({name: _seen(source, ordinal, step) for name, (source, step) in wanted.items()})
    return with_all.filter(~F.col("_lent")).select(*[c for c in df.columns if c not in wanted], *wanted)


def neighbour(df: DataFrame, group: list[str], ordinal: str, columns: dict[str, str], step: int = 1) -> DataFrame:
    """``df`` with ``columns`` (source to new name) of the row ``step`` positions further; null where there is none."""
    return neighbours(df, group, ordinal, {new: (source, step) for source, new in columns.items()})


def _carried(inside: DataFrame, group: list[str], value: str, into: str, whole: bool) -> DataFrame:
    """The running sum of ``value`` in rows that lie by ``_at`` and sort by ``_order``, stretch totals carried over."""
    before = Window.partitionBy(*group).orderBy("_home").rowsBetween(Window.unboundedPreceding, -1)
    sums = inside.groupBy("_at").agg(F.sum(value).alias("_t")).select("_t", *[F.col(f"_at.{g}").alias(g) for g in group], F.col("_at._home").alias("_home"))
    base = sums.select(F.struct(*group, "_home").alias("_at"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    upto = Window.partitionBy("_at").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0 if whole else -1)
    return inside.withColumn("_in", F.coalesce(F.sum(value).over(upto), F.lit(0))).join(base, "_at").withColumn(into, F.col("_base") + F.col("_in")).drop("_base", "_in")


def running(df: DataFrame, group: list[str], ordinal: str, value: Column, into: str, whole: bool = True) -> DataFrame:
    """The sum of ``value`` over the rows of the group up to each row, itself included if ``whole``; nulls count 0."""
    v = df.withColumns({"_v": F.coalesce(value, F.lit(0)), "_order": F.col(ordinal), "_home": _stretch(ordinal)}).withColumn("_at", F.struct(*group, "_home"))
    return _carried(v, group, "_v", into, whole).select(*[c for c in df.columns if c != into], into)


def islands(df: DataFrame, group: list[str], ordinal: str, keys: list[str], into: str = "run") -> DataFrame:
    """Consecutive rows with the same ``keys`` (nulls being equal) numbered from 1 as runs."""
    lent = _with_edges(df, group, ordinal, 1)
    mark = F.struct(*keys)
    back = lent.withColumns({"_mark": mark, "_order": F.col(ordinal)})
    fresh = (~_seen("_mark", ordinal, -1).eqNullSafe(F.col("_mark"))).cast("int")
    v = back.withColumn("_v", fresh).filter(~F.col("_lent"))
    return _carried(v, group, "_v", into, True).select(*[c for c in df.columns if c != into], into)


def last_by_level(df: DataFrame, group: list[str], ordinal: str, level: str, levels: list[int], into: str) -> DataFrame:
    """``df`` with ``into``: the greatest ordinal before the row among rows of a smaller ``level``; null where there is none.

    ``levels`` are all levels that occur, a short list. For each of them the
    greatest ordinal so far is a running maximum within a stretch, and the
    maxima of earlier stretches are carried over.
    """
    names = {x: f"_l{i}" for i, x in enumerate(levels)}
    own = {n: F.when(F.col(level) == x, F.col(ordinal)) for x, n in names.items()}
    v = df.withColumn("_home", _stretch(ordinal)).withColumn("_at", F.struct(*group, "_home"))
    tops = v.groupBy(*group, "_home").agg(*[F.max(c).alias(n) for n, c in own.items()])
    earlier = Window.partitionBy(*group).orderBy("_home").rowsBetween(Window.unboundedPreceding, -1)
    base = tops.select(F.struct(*group, "_home").alias("_at"), *[F.max(n).over(earlier).alias(f"_b{n}") for n in own])
    upto = Window.partitionBy("_at").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    inside = v.withColumns({n: F.max(c).over(upto) for n, c in own.items()}).join(base, "_at")
    below = [F.when(F.col(level) > x, F.coalesce(F.col(n), F.col(f"_b{n}"))) for x, n in names.items()]
    return inside.withColumn(into, F.greatest(*below, F.lit(None).cast("bigint"))).select(*[c for c in df.columns if c != into], into)


def fold(df: DataFrame, group: list[str], order: list[str], step: Callable[[object, dict], tuple[object, dict]], adds: str) -> DataFrame:
    """A sequential scan of each group: ``step(state, row)`` gives the new state and the added columns of the row.

    The state is None at a group's first row. Rows are brought together by
    group and sorted, then streamed through Python batch by batch: a group is
    never held in memory, whatever its size. Used only where the rule at a row
    depends on all choices made before it.
    """
    sorted_rows = df.repartition(*group).sortWithinPartitions(*group, *order)
    base = df.sparkSession.createDataFrame([], adds).schema
    names = [f.name for f in base]
    kept = [c for c in df.columns if c not in names]
    schema = df.select(*kept).schema
    for f in base:
        schema = schema.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, begun = None, None, False
        for b in batches:
            rows, out = b.to_pylist(), []
            for row in rows:
                key = tuple(row[g] for g in group)
                if not begun or key != last:
                    last, state, begun = key, None, True
                state, added = step(state, row)
                out.append(added)
            types = [f.dataType.simpleString() for f in base]
            made = [pa.array([o[n] for o in out], {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}[t]) for n, t in zip(names, types)]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], *made], names=[*kept, *names])

    return sorted_rows.mapInArrow(run, schema)
