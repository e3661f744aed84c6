"""How far each source has come: exports, stages, states of rewriting, and what a run did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.inventory import extension

#: Stages of a source in their order; each needs the one before it.
STAGES = ["source", "canonical", "chunks", "dataset", "derivative"]

#: States of the parts of a rewritten document.
NEEDS_REVIEW, UNCHANGED, FAILURE, UNAVAILABLE, WARNINGS, DONE = "needs_human_review", "unchanged_clean", "model_failure", "model_unavailable", "reconstructed_with_warnings", "reconstructed"


def discovered(exports: DataFrame, manifest: DataFrame) -> DataFrame:
    """``path, state`` of every export: ``ok``, ``not_in_manifest``, ``not_successful`` or ``hash_differs``.

    ``exports``: ``path, sha256``; ``manifest``: ``path, sha256, status``, one
    row per path. Only ``ok`` ones are fit for use; a caller that wants an
    error asks whether any other is there.
    """
    m = manifest.select("path", F.col("sha256").alias("_hash"), F.col("status").alias("_status"), F.lit(True).alias("_there"))
    state = F.when(F.col("_there").isNull(), "not_in_manifest").when(~F.col("_status").isin("exported", "exported_with_warnings"), "not_successful").when(~F.col("_hash").eqNullSafe(F.col("sha256")), "hash_differs").otherwise("ok")
    return exports.join(m, "path", "left").select("path", state.alias("state"))


def eligible(files: DataFrame, path: str, supported: list[str], wanted: list[str], most: int) -> DataFrame:
    """The first ``most`` files by path whose extension is supported and wanted."""
    return files.filter(extension(F.col(path)).isin(sorted(set(supported) & set(wanted)))).orderBy(path).limit(most)


def export_outcome(characters: Column, warnings: Column, scanned: Column, supported: Column) -> Column:
    """``unsupported``, ``requires_ocr`` or ``empty`` where no text came out, else ``exported`` or ``exported_with_warnings``."""
    none = F.coalesce(characters, F.lit(0)) == 0
    return F.when(~supported, "unsupported").when(none & scanned, "requires_ocr").when(none, "empty").when(F.coalesce(warnings, F.lit(0)) > 0, "exported_with_warnings").otherwise("exported")


def furthest(sources: DataFrame, stages: dict[str, DataFrame], key: str) -> DataFrame:
    """``key, stage, complete``: the furthest stage that a source has reached without a gap.

    ``stages`` maps the stages after the first, in their order, to tables of
    the keys that passed them. A stage counts only if all before it do.
    """
    joined = sources.select(key).distinct()
    for name, passed in stages.items():
        joined = joined.join(passed.select(key).distinct().withColumn(f"_{name}", F.lit(True)), key, "left")
    stage, valid = F.lit("source"), F.lit(True)
    for name in stages:
        valid = valid & F.coalesce(f"_{name}", F.lit(False))
        stage = F.when(valid, name).otherwise(stage)
    return joined.select(key, stage.alias("stage"), valid.alias("complete"))


def reconstruction_status(parts: DataFrame, readiness: DataFrame) -> DataFrame:
    """``document_id, status``: the state of a rewritten document by those of its parts.

    ``parts``: ``document_id, status``; ``readiness``: ``document_id,
    readiness`` of every document. Review comes first, then partial documents of
    which nothing was changed, failures, and what is unusable or image
    dependent throughout; a rest that is so gives warnings. A document without
    parts is unusable, unless it needs review.
    """
    every = lambda *s: F.bool_and(F.col("status").isin(*s))
    some = lambda *s: F.bool_or(F.col("status").isin(*s))
    g = parts.groupBy("document_id").agg(
        some(NEEDS_REVIEW).alias("review"), every(UNCHANGED).alias("unchanged"), some(FAILURE).alias("failed"), some(UNAVAILABLE).alias("away"), every("unusable").alias("unusable"), (every("image_dependent", "unusable") & some("image_dependent")).alias("image"), some("image_dependent", "unusable", WARNINGS).alias("warned"),
    )
    ladder = [
        ("review", NEEDS_REVIEW), ("readiness = 'human_review_required'", NEEDS_REVIEW), ("unchanged is null", "unusable"), ("readiness = 'partially_reconstructable' and unchanged", "partially_reconstructable"), ("failed", FAILURE), ("away", UNAVAILABLE), ("unusable", "unusable"), ("image", "image_dependent"), ("warned", WARNINGS), ("unchanged", UNCHANGED),
    ]
    status = F.lit(DONE)
    for condition, name in reversed(ladder):
        status = F.when(F.coalesce(F.expr(condition), F.lit(False)), name).otherwise(status)
    return readiness.join(g, "document_id", "left").select("document_id", status.alias("status"))


def run_report(counted: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``measure, value, n``: counts of a run, one row for each value of each measure (name to table and column)."""
    out = None
    for measure, (df, column) in counted.items():
        rows = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("none")).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(measure).alias("measure"), "value", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def export_entry(path: Column, sha256: Column, outcome: Column, tool: Column) -> Column:
    """Id of the entry of an export: equal for equal source, result and tool."""
    return X.identity(path, sha256, outcome, tool)


def second_decisions(events: DataFrame, key: str, stamp: str, order: str, status: str, terminal: list[str]) -> DataFrame:
    """``key, decisions, first_status``: what was decided more than once, though a decision ends the matter; the first one holds.

    ``events`` is an append-only log; ties on the time go to the smaller ``order``.
    """
    ended = events.filter(F.col(status).isin(terminal))
    g = ended.groupBy(key).agg(F.count(F.lit(1)).alias("decisions"), F.min_by(status, F.struct(stamp, order)).alias("first_status"))
    return g.filter("decisions > 1")
