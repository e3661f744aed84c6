"""Generated questions held against the chunks they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.selection import similar_sets

#: Phrases by which a text corrects its source, lower case; the least share of a claim's words that its evidence holds; the similarity of near duplicates.
CORRECTIONS = ["likely a typo", "probable typo", "should be interpreted as", "likely an error", "erreur probable", "coquille probable", "doit être interprété", "doit etre interprete", "semble être une erreur", "semble etre une erreur"]
SUPPORT, NEAR = 0.35, 0.85


def corrections(text: Column) -> Column:
    """The phrases of correction in a text, case aside."""
    folded = X.fold_case(text)
    return F.array_compact(F.array(*[F.when(F.contains(folded, F.lit(p)), F.lit(p)) for p in CORRECTIONS]))


def question_issues(questions: DataFrame, chunks: DataFrame, selected: DataFrame) -> DataFrame:
    """``question_id, code`` of everything wrong with a question.

    ``questions``: ``question_id, stem, claim`` (answers and explanation),
    ``chunk_ids`` (cited), ``evidence_chunk, quotation, review``; ``chunks``:
    ``chunk_id, text, eligible``; ``selected``: ``chunk_id`` of those that were
    to be used. Citations are exploded and joined by the chunk; stems are
    compared by prefix filtering, equal ones by a count.
    """
    cited = questions.select("question_id", F.explode("chunk_ids").alias("chunk_id")).distinct()
    about = chunks.select("chunk_id", "eligible", F.lit(True).alias("exists"))
    met = cited.join(about, "chunk_id", "left").join(selected.select("chunk_id", F.lit(True).alias("chosen")).distinct(), "chunk_id", "left")
    codes = {"nonexistent_chunk_reference": F.col("exists").isNull(), "excluded_chunk_used": F.col("exists") & ~F.coalesce("eligible", F.lit(False)), "unselected_chunk_used": F.col("exists") & F.col("chosen").isNull()}
    out = met.select("question_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in codes.items()]))).alias("code"))
    texts = chunks.select(F.col("chunk_id").alias("evidence_chunk"), F.col("text").alias("evidence"))
    q = questions.join(texts, "evidence_chunk", "left")
    quotation = F.coalesce("quotation", F.lit(""))
    claim, said = X.claim_words(F.coalesce("claim", F.lit(""))), X.claim_words(quotation)
    q = q.withColumns({"claim_words": claim, "said": said, "claimed": X.numbers(F.coalesce("claim", F.lit(""))), "given": X.numbers(quotation), "stem_and_claim": F.concat_ws(" ", "stem", "claim")})
    found = X.contained(F.col("claim_words"), F.col("said"))
    wrong = {
        "invalid_initial_review_state": ~F.col("review").eqNullSafe("unreviewed"), "invalid_evidence_chunk": ~F.coalesce(F.array_contains("chunk_ids", F.col("evidence_chunk")), F.lit(False)) | F.col("evidence").isNull() | (F.size(F.array_distinct("chunk_ids")) != 1),
        "evidence_quotation_mismatch": F.col("evidence").isNotNull() & ((quotation == "") | ~F.contains("evidence", quotation)), "unsupported_numeric_claim": F.size(F.array_except("claimed", "given")) > 0, "source_correction_language": F.size(corrections(F.col("stem_and_claim"))) > 0, "low_lexical_support": found < SUPPORT,
    }
    out = out.unionByName(q.select("question_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in wrong.items()]))).alias("code")))
    stems = questions.select("question_id", X.key_text(F.coalesce("stem", F.lit(""))).alias("key"), F.lit("").alias("all"))
    first = stems.groupBy("key").agg(F.min("question_id").alias("first"))
    again = stems.join(first, "key").filter("question_id <> first").select("question_id", F.lit("duplicate_question").alias("code"))
    heads = stems.join(first, "key").filter("question_id = first").select("all", "question_id", X.claim_words(F.col("key")).alias("words"))
    near = similar_sets(heads, "all", "question_id", "words", NEAR).select(F.col("right_key").alias("question_id"), F.lit("near_duplicate_question").alias("code")).distinct()
    return out.unionByName(again).unionByName(near)


def distribution_issues(questions: DataFrame, wanted: DataFrame, short: bool = False) -> DataFrame:
    """``difficulty, wanted, found`` of every difficulty whose number of questions is not the wanted one (``short``: is more than it)."""
    found = questions.groupBy("difficulty").agg(F.count(F.lit(1)).alias("found"))
    both = wanted.select("difficulty", "wanted").join(found, "difficulty", "full").select("difficulty", F.coalesce("wanted", F.lit(0)).cast("bigint").alias("wanted"), F.coalesce("found", F.lit(0)).cast("bigint").alias("found"))
    return both.filter(F.col("found") > F.col("wanted") if short else F.col("found") != F.col("wanted"))


def accepted(*batches: DataFrame, status: str = "status", wanted: str = "accepted") -> DataFrame:
    """The accepted rows of all batches together; a row that stands in several is kept as often."""
    out = batches[0].filter(F.col(status) == wanted)
    for b in batches[1:]:
        out = out.unionByName(b.filter(F.col(status) == wanted))
    return out
