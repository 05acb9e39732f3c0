"""Ranks, reciprocal rank fusion, cross annotation and candidate selection.

All of these work on at most a few hundred ranked rows, after the top-k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K, OVERFETCH, CANDIDATES, CANDIDATE_OVERFETCH = 60, 4, 40, 2


def fetch_size(limit: int, fused: bool, rerank: bool = False, candidates: int = CANDIDATES) -> int:
    base = limit * OVERFETCH if fused else limit
    return max(base, candidates * CANDIDATE_OVERFETCH) if rerank else base


def ranked(branch: DataFrame, name: str, *order) -> DataFrame:
    """chunk_id, <name>_rank from 1, <name>_score of an ordered branch."""
    place = F.row_number().over(Window.orderBy(*(order or (F.desc("score"), "chunk_id"))))
    return branch.select("chunk_id", place.alias(f"{name}_rank"), F.col("score").alias(f"{name}_score"))


def fuse(vector: DataFrame, fts: DataFrame, k: int = RRF_K) -> DataFrame:
    """Union of two ranked branches with both ranks, rrf_score and fused position.

    Ties keep the order of first appearance: rows of the vector branch in rank order, then
    rows that only the text branch has.
    """
    both = vector.unionByName(fts, allowMissingColumns=True).groupBy("chunk_id").agg(*[F.max(c).alias(c) for c in ("vector_rank", "vector_score", "fts_rank", "fts_score")])
    zero = F.lit(0.0)
    both = both.withColumn("rrf_score", F.coalesce(1.0 / (k + F.col("vector_rank")), zero) + F.coalesce(1.0 / (k + F.col("fts_rank")), zero))
    order = Window.orderBy(F.desc("rrf_score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("fts_rank"))
    return both.withColumn("fused_rank", F.row_number().over(order))


def annotate(hits: DataFrame, other: DataFrame) -> DataFrame:
    """hits with the ranks and scores of another branch filled in by id."""
    return hits.join(other, "chunk_id", "left")


def select_candidates(fused: DataFrame, count: int = CANDIDATES) -> DataFrame:
    """An equal share from the head of each branch, topped up in fused order; the result is in fused order."""
    share = count // 2
    head = F.coalesce(F.col("vector_rank") <= share, F.lit(False)) | F.coalesce(F.col("fts_rank") <= share, F.lit(False))
    chosen = fused.withColumn("_place", F.row_number().over(Window.orderBy(head.desc(), "fused_rank"))).where(F.col("_place") <= count)
    return chosen.withColumn("candidate_rank", F.row_number().over(Window.orderBy("fused_rank"))).drop("_place")
