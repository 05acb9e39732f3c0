"""Golden-set evaluation: evidence ranks, recall and MRR, gate and answer metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidspark.functions.text import contains_normalized, normalize_for_match

CUTOFFS = (5, 10, 40)


def evidence_matches(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, evidence, chunk_id where a chunk of the named document holds any snippet of the evidence. The document is an equality, so this is no nested loop."""
    wanted = questions.select("id", F.posexplode("evidence").alias("evidence", "e")).select("id", "evidence", F.col("e.doc").alias("document_id"), F.explode("e.contains").alias("s")).withColumn("needle", normalize_for_match(F.col("s")))
    texts = chunks.select("document_id", "chunk_id", "content_kind", normalize_for_match(F.col("chunk_raw")).alias("hay"))
    return wanted.join(texts, "document_id").where(contains_normalized(F.col("hay"), F.col("needle"))).select("id", "evidence", "chunk_id", "content_kind").distinct()


def first_ranks(questions: DataFrame, matches: DataFrame, ranked: DataFrame) -> DataFrame:
    """id, type, mode, evidence, rank (null if not found) for (id, mode, chunk_id, rank)."""
    each = questions.select("id", "type", F.posexplode("evidence").alias("evidence", "e")).drop("e").crossJoin(F.broadcast(ranked.select("mode").distinct()))  # a handful of modes
    found = matches.join(ranked, ["id", "chunk_id"]).groupBy("id", "mode", "evidence").agg(F.min("rank").alias("rank"))
    return each.join(found, ["id", "mode", "evidence"], "left")


def per_question(ranks: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """id, type, mode, recall at each cutoff, first rank, reciprocal rank."""
    def within(k: int) -> Column:
        return F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}")

    return ranks.groupBy("id", "type", "mode").agg(*map(within, cutoffs), F.min("rank").alias("first_rank"), F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"))


def summarize(scores: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """Means by mode, over all questions (type `all`) and by type, in one pass of grouping sets."""
    names = [f"recall_{k}" for k in cutoffs]
    grouped = scores.groupingSets([[F.col("mode")], [F.col("mode"), F.col("type")]], F.col("mode"), F.col("type"))
    return grouped.agg(F.count("*").alias("questions"), *[F.round(F.avg(n), 6).alias(n) for n in names], F.round(F.avg("reciprocal_rank"), 6).alias("mrr")).withColumn("type", F.coalesce("type", F.lit("all")))


def gate_summary(questions: DataFrame, graded: DataFrame, matches: DataFrame, least: int = 2) -> DataFrame:
    """How the gate did: answerable questions with a relevant chunk through it, with anything through it, negatives it closed for."""
    flags = graded.where(F.col("grade").isNull() | (F.col("grade") >= least)).join(matches.select("id", "chunk_id", F.lit(True).alias("hit")).distinct(), ["id", "chunk_id"], "left")
    per = questions.select("id", F.size("evidence").alias("wanted")).join(flags.groupBy("id").agg(F.count("*").alias("passed"), F.bool_or(F.coalesce("hit", F.lit(False))).alias("relevant")), "id", "left")
    yes, relevant, passed = F.col("wanted") > 0, F.coalesce("relevant", F.lit(False)), F.coalesce("passed", F.lit(0))
    return per.agg(F.count_if(yes).alias("answerable"), F.count_if(yes & relevant).alias("relevant_passed"), F.count_if(yes & (passed > 0)).alias("any_passed"), F.count_if(~yes).alias("negatives"), F.count_if(~yes & (passed == 0)).alias("negatives_closed"))


def upper_median(name: str) -> Column:
    """sorted[n // 2] of a column, as an aggregate of counts by value that combines before the shuffle."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{name}` DESC)")


def answer_summary(answers: DataFrame) -> DataFrame:
    """answers (status, negative, expected_in_context, cited_expected, statements, verified, server_ms)."""
    status = F.col("status")
    return answers.agg(
        F.count_if(~F.col("negative") & (status == "answered")).alias("answered"),
        F.count_if(~F.col("negative") & (status == "partial")).alias("partial"),
        F.count_if(~F.col("negative") & (status == "insufficient")).alias("insufficient"),
        F.count_if(~F.col("negative") & F.col("expected_in_context")).alias("in_context"),
        F.count_if(~F.col("negative") & F.col("cited_expected")).alias("cited"),
        F.sum("statements").alias("statements"),
        F.sum("verified").alias("verified"),
        F.count_if(F.col("negative") & status.isin("no_evidence", "insufficient")).alias("refused"),
        upper_median("server_ms").alias("median_ms"),
    )


def check_golden(questions: DataFrame, matches: DataFrame) -> DataFrame:
    """id, evidence, problem: evidence that no chunk holds, and annex questions without an annex chunk."""
    wanted = questions.select("id", "type", F.posexplode("evidence").alias("evidence", "e")).drop("e")
    missing = wanted.join(matches.select("id", "evidence").distinct(), ["id", "evidence"], "left_anti").select("id", "evidence", F.lit("no chunk holds it").alias("problem"))
    annex = matches.where("content_kind = 'annex'").select("id").distinct()
    plain = wanted.where("type = 'annex'").join(annex, "id", "left_anti").select("id", "evidence", F.lit("no annex chunk holds it").alias("problem"))
    return missing.unionByName(plain)


def evidence_in_answer(questions: DataFrame, matches: DataFrame, sources: DataFrame) -> DataFrame:
    """id, expected_in_context, cited_expected over an answer's sources (id, chunk_id, cited)."""
    hit = matches.select("id", "chunk_id").distinct().join(sources.select("id", "chunk_id", "cited"), ["id", "chunk_id"])
    flags = hit.groupBy("id").agg(F.lit(True).alias("expected_in_context"), F.bool_or("cited").alias("cited_expected"))
    no = F.lit(False)
    return questions.select("id").join(flags, "id", "left").select("id", F.coalesce("expected_in_context", no).alias("expected_in_context"), F.coalesce("cited_expected", no).alias("cited_expected"))
