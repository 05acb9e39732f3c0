"""Grading of candidates: protocol, alignment, order, batches and the relevance gate."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidspark.functions.text import collapse, escaped_json
from evidspark.operators.index import lexemes_of

MIN_GRADE, MAX_GRADE, BATCH, REASON_CHARS = 2, 3, 20, 200


class Grader(Protocol):
    """Grades candidates of one question; returns chunk_id, grade, reason."""

    model: str | None

    def grade(self, question: str, hits: DataFrame) -> DataFrame: ...


class NoGrader:
    """Leaves every grade null, so everything passes the gate."""

    model = None

    def grade(self, question: str, hits: DataFrame) -> DataFrame:
        return hits.select("chunk_id", F.lit(None).cast("int").alias("grade"), F.lit(None).cast("string").alias("reason"))


class LexicalGrader:
    """Deterministic stand-in for a model: the share of the question's words that the chunk has, in four steps."""

    model = None

    def grade(self, question: str, hits: DataFrame) -> DataFrame:
        from evidspark.functions.text import tokens

        words = sorted({x for w in question.split() for x in lexemes_of(w)})
        wanted = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
        share = F.size(F.array_intersect(F.array_distinct(tokens(F.col("chunk_raw"))), wanted)) / F.lit(max(1, len(words)))
        grade = F.when(share >= 0.75, 3).when(share >= 0.5, 2).when(share > 0, 1).otherwise(0)
        return hits.select("chunk_id", grade.cast("int").alias("grade"), F.format_string("%.0f%% of the words", share * 100).alias("reason"))


def align(hits: DataFrame, grades: DataFrame) -> DataFrame:
    """hits with a grade each: unknown ids ignored, the first of several kept (by ordinal), 0 to 3, missing is 0."""
    first = grades.withColumn("_n", F.row_number().over(Window.partitionBy("chunk_id").orderBy("ordinal"))).where("_n = 1")
    kept = first.select("chunk_id", F.greatest(F.lit(0), F.least(F.lit(MAX_GRADE), F.col("grade"))).alias("rerank_grade"), F.substring(collapse(F.col("reason")), 1, REASON_CHARS).alias("rerank_reason"))
    return hits.join(kept, "chunk_id", "left").withColumns({"rerank_grade": F.coalesce("rerank_grade", F.lit(0)), "rerank_reason": F.coalesce("rerank_reason", F.lit(""))})


def order_by_grade(hits: DataFrame, keys: tuple[str, ...] = (), ties: str = "candidate_rank") -> DataFrame:
    """hits with their place by falling grade (null counts as 0), then candidate rank; keys tell candidate lists apart."""
    order = Window.partitionBy(*keys).orderBy(F.coalesce("rerank_grade", F.lit(0)).desc(), ties)
    return hits.withColumn("rerank_rank", F.row_number().over(order))


def passes_gate(grade: Column, least: int = MIN_GRADE) -> Column:
    return grade.isNull() | (grade >= least)


def batch_of(rank: Column, size: int = BATCH) -> Column:
    """The call that a candidate belongs to; fixed, because grades depend on their batch."""
    return F.floor((rank - 1) / size).cast("int")


def prompt_lines(hits: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, chunk_id, candidate_rank, batch, line: one escaped JSON line for each candidate."""
    row = F.struct(F.col("candidate_rank").alias("id"), F.col("section"), F.col("chunk_raw").alias("text"))
    return hits.select(*keys, "chunk_id", "candidate_rank", batch_of(F.col("candidate_rank")).alias("batch"), escaped_json(row).alias("line"))


def prompts(hits: DataFrame, question: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, batch, prompt: the lines of a batch in order, the question last; keys tell candidate lists apart."""
    grouped = prompt_lines(hits, keys).groupBy(*keys, "batch").agg(F.array_sort(F.collect_list(F.struct("candidate_rank", "line"))).alias("x"))
    return grouped.select(*keys, "batch", F.concat(F.array_join(F.transform("x", lambda r: r["line"]), "\n"), F.lit("\n" + " ".join(question.split()))).alias("prompt"))


def cached(hits: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with a cached grade, hits without); cache is keyed by sha256 of question, model and chunk text."""
    known = hits.join(cache, "cache_key")
    return known, hits.join(cache.select("cache_key"), "cache_key", "left_anti")


def cache_key(question: str, model: str | None, text: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", F.lit(" ".join(question.lower().split())), F.lit(model or ""), text), 256), 1, 32)


def add_usage(calls: DataFrame, keys: tuple[str, ...] = ("prompt_tokens", "output_tokens", "total_tokens"), by: tuple[str, ...] = ()) -> DataFrame:
    """Token use over calls, or over those of each group; missing counts as 0."""
    return calls.groupBy(*by).agg(*[F.sum(F.coalesce(k, F.lit(0))).alias(k) for k in keys])
