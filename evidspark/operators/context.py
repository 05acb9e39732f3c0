"""Evidence packing: gate, per-document cap, token budget, neighbours, numbering, rendering.

Greedy packing is sequential, but only over the candidates of one question, so these are
one sorted array: many questions share an Arrow batch, and only documents and costs go to Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidspark.functions.text import escaped_json, page_label
from evidspark.operators.grading import MIN_GRADE
from evidspark.runtime import materialize, ship

MAX_SOURCES, TOKEN_BUDGET, PER_DOCUMENT, MAX_NEIGHBOURS, CHARS_PER_TOKEN = 8, 10_000, 3, 4, 3
FOUND, CONTEXT = "nalezeno", "kontext"


def token_cost(tokens, text):
    """Stored token count, or one for every three characters."""
    return F.when(F.coalesce(tokens, F.lit(0)) > 0, tokens).otherwise(F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / CHARS_PER_TOKEN))).cast("int")


def per_document_cap(hits: DataFrame, most: int = PER_DOCUMENT) -> DataFrame:
    """The first `most` hits of each document by rank."""
    return hits.withColumn("document_place", F.row_number().over(Window.partitionBy("question_id", "document_id").orderBy("rank"))).where(F.col("document_place") <= most)


def pack(hits: DataFrame, min_grade: int = MIN_GRADE, max_sources: int = MAX_SOURCES, budget: int = TOKEN_BUDGET, per_document: int = PER_DOCUMENT, carry: tuple[str, ...] = ()) -> DataFrame:
    """Chosen hits (question_id, chunk_id, document_id, rank, cost, columns to carry, position) of (question_id, rank, chunk_id, document_id, cost, rerank_grade).

    Best first under the cap, then the rest without it; a hit over the budget is skipped, not the end.
    """
    ship(hits.sparkSession)
    rows = hits.where(F.col("rerank_grade").isNull() | (F.col("rerank_grade") >= min_grade)).select("question_id", "rank", "chunk_id", "document_id", "cost", *carry)

    hit = F.struct("rank", "chunk_id", "document_id", "cost", *carry)
    lists = rows.groupBy("question_id").agg(F.sort_array(F.collect_list(hit)).alias("hits"))

    @F.pandas_udf("array<int>")
    def choose(documents: pd.Series, costs: pd.Series) -> pd.Series:
        return pd.Series([_chosen(d.tolist(), c.tolist(), max_sources, budget, per_document) for d, c in zip(documents, costs, strict=True)], dtype=object)

    picked = lists.withColumn("picked", choose(F.col("hits.document_id"), F.col("hits.cost")))
    placed = picked.select("question_id", F.posexplode(F.transform("picked", lambda i: F.get("hits", i))).alias("place", "h"))
    return placed.select("question_id", *[F.col(f"h.{c}").alias(c) for c in ("rank", "chunk_id", "document_id", "cost", *carry)], (F.col("place") + 1).alias("position"))


def greedy(rows: pd.DataFrame, max_sources: int, budget: int, per_document: int) -> list[int]:
    """Row numbers in the order of choice."""
    return _chosen(rows["document_id"].tolist(), rows["cost"].tolist(), max_sources, budget, per_document)


def _chosen(documents: list, costs: list, max_sources: int, budget: int, per_document: int) -> list[int]:
    picked: list[int] = []
    used, spent = {}, 0
    for cap in (per_document, None):
        for i, (d, c) in enumerate(zip(documents, costs, strict=True)):
            if len(picked) == max_sources:
                return picked
            if i in picked or spent + c > budget or cap is not None and used.get(d, 0) >= cap:
                continue
            picked.append(i)
            used[d] = used.get(d, 0) + 1
            spent += c
    return picked


def neighbours(chosen: DataFrame, chunks: DataFrame, before: int = 1, after: int = 1, same_section: bool = True) -> DataFrame:
    """Chunks next to chosen ones: same document, index in range, not chosen themselves; each once, by the best chosen place.

    Chosen chunks name the places that they want, so chunks meet them by place, once and without their texts.
    """
    near = chunks.select("document_id", "chunk_index", "chunk_id", "section", token_cost(F.col("token_count"), F.col("chunk_raw")).alias("cost"))
    places = F.filter(F.sequence(F.greatest(F.lit(0), F.col("chunk_index") - before), F.col("chunk_index") + after), lambda i: i != F.col("chunk_index"))
    wanted = chosen.where(F.col("chunk_index") + after >= 0).select("question_id", "document_id", F.coalesce("section", F.lit("")).alias("own_section"), "position", F.explode(places).alias("chunk_index"))
    both = near.join(wanted, ["document_id", "chunk_index"])
    both = both.where(F.coalesce("section", F.lit("")) == F.col("own_section")) if same_section else both
    fresh = both.join(chosen.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti")
    return fresh.groupBy("question_id", "document_id", "chunk_id", "chunk_index", "section", "cost").agg(F.min("position").alias("position"))


def add_neighbours(chosen: DataFrame, chunks: DataFrame, budget: int = TOKEN_BUDGET, most: int = MAX_NEIGHBOURS) -> DataFrame:
    """chosen plus up to `most` neighbours that fit the budget, role and null grade set; question_id, chunk_id, document_id, chunk_index, section, cost, position, rerank_grade."""
    chosen = materialize(chosen, "chosen")  # a few rows a question, read four times
    columns = ["question_id", "chunk_id", "document_id", "chunk_index", "section", "cost", "position"]
    spent = chosen.groupBy("question_id").agg(F.sum("cost").alias("spent"))
    order = F.struct("position", "chunk_index", "chunk_id", "document_id", "section", "cost")
    near = neighbours(chosen, chunks).groupBy("question_id").agg(F.sort_array(F.collect_list(order)).alias("near"))

    def take(state: Column, x: Column) -> Column:
        fits = (F.size(state["taken"]) < most) & (state["spent"] + x["cost"] <= budget)
        return F.when(fits, F.struct((state["spent"] + x["cost"]).alias("spent"), F.concat(state["taken"], F.array(x)).alias("taken"))).otherwise(state)

    none = F.struct(F.col("spent").cast("bigint").alias("spent"), F.filter("near", lambda x: F.lit(False)).alias("taken"))
    extra = near.join(spent, "question_id").select("question_id", F.explode(F.aggregate("near", none, take)["taken"]).alias("x")).select("question_id", "x.*")
    return chosen.select(*columns, "rerank_grade", F.lit(FOUND).alias("role")).unionByName(extra.select(*columns, F.lit(None).cast("int").alias("rerank_grade"), F.lit(CONTEXT).alias("role")))


def number_sources(sources: DataFrame) -> DataFrame:
    """sources with id 1..n: documents by best grade, then first position; chunks in reading order."""
    doc = Window.partitionBy("question_id", "document_id")
    keyed = sources.withColumns({"_best": F.max(F.coalesce("rerank_grade", F.lit(0))).over(doc), "_first": F.min("position").over(doc)})
    order = Window.partitionBy("question_id").orderBy(F.desc("_best"), "_first", "document_id", "chunk_index")
    return keyed.withColumn("id", F.row_number().over(order)).drop("_best", "_first")


def render(sources: DataFrame) -> DataFrame:
    """question_id, prompt: a document line where the document changes, then a line for each chunk."""
    order = Window.partitionBy("question_id").orderBy("id")
    head = escaped_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("dokument", "title"), ("obec", "municipality"), ("typ", "report_type"), ("datum", "report_date"), ("zpracovatel", "organization"))]))
    part = F.when(F.col("content_kind") == "annex", "příloha").otherwise("tělo zprávy")
    line = escaped_json(F.struct("id", F.coalesce("section", F.lit("")).alias("sekce"), page_label(F.col("page_from"), F.col("page_to")).alias("strany"), part.alias("cast"), F.coalesce("role", F.lit(FOUND)).alias("role"), F.coalesce("chunk_raw", F.lit("")).alias("text")))
    new = ~F.lag("document_id").over(order).eqNullSafe(F.col("document_id"))
    rows = sources.select("question_id", "id", F.when(new, F.concat(head, F.lit("\n"), line)).otherwise(line).alias("line"))
    joined = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("id", "line"))).alias("x"))
    return joined.select("question_id", F.concat(F.lit("<zdroje>\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n"), F.lit("\n</zdroje>")).alias("prompt"))
