"""Listing, facets, counts and single documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACETS = ("author", "client", "locality", "municipality", "report_type", "organization")


def list_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their chunk counts, newest first, documents without chunks included. Counts come before the join, so no document's text is shuffled."""
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"))
    zero = F.lit(0).cast("bigint")
    out = documents.join(counts, "document_id", "left").withColumns({"chunks": F.coalesce("chunks", zero), "embedded": F.coalesce("embedded", zero)})
    return out.orderBy(F.desc_nulls_last("report_date"), "title", "document_id")


def facets(documents: DataFrame, names: tuple[str, ...] = FACETS) -> DataFrame:
    """field, value, n of every non-blank value: one pass, each row unpivoted."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in names])).alias("x")
    found = documents.select(pairs).select("x.*").where("value is not null and value <> ''")
    return found.groupBy("field", "value").agg(F.count("*").alias("n")).orderBy("field", F.desc("n"), "value")


def year_span(documents: DataFrame, date_col: str = "report_date") -> DataFrame:
    return documents.agg(F.min(F.year(date_col)).alias("first_year"), F.max(F.year(date_col)).alias("last_year"))


def content_kinds(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.coalesce("content_kind", F.lit("prose")).alias("content_kind")).agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"))


def corpus_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    d = documents.agg(F.count("*").alias("documents"))
    c = chunks.agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"))
    return d.crossJoin(F.broadcast(c))  # one row each


def window_around(chunks: DataFrame, document_id, index: int, before: int = 1, after: int = 1) -> DataFrame:
    """Chunks around a place of a document, with the place itself marked."""
    if not 0 <= before <= 5 or not 0 <= after <= 5:
        raise ValueError("before and after lie between 0 and 5")
    rows = chunks.where((F.col("document_id") == document_id) & F.col("chunk_index").between(max(0, index - before), index + after))
    return rows.withColumn("is_hit", F.col("chunk_index") == index).orderBy("chunk_index")


def document(documents: DataFrame, document_id) -> DataFrame:
    return documents.where(F.col("document_id") == document_id)


def hydrate(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The survivors of a top-k with chunk and document columns; expensive columns are made only for them.

    The planner broadcasts hits while they are small, as a top-k is, and joins by sorting beyond.
    """
    wide = hits.join(chunks.drop("document_id", "chunk_index") if {"document_id", "chunk_index"} <= set(hits.columns) else chunks, "chunk_id")
    return wide.join(documents, "document_id")


def json_field(column: str, path: str, kind: str = "string") -> Column:
    """A field of a JSON text by its dotted path, null where it is missing or of another kind."""
    return F.get_json_object(column, f"$.{path}").try_cast(kind)


def joined_values(rows: DataFrame, keys: list[str], column: str, name: str, separator: str = " | ") -> DataFrame:
    """keys and name: the distinct values of a column, in order, as one text. Repeats go before values are gathered."""
    distinct = rows.select(*keys, column).distinct()
    return distinct.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(column)), separator).alias(name))


def latest_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns, by a partial maximum and no window."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_last")).select(*keys, *[F.col("_last").getField(c).alias(c) for c in (*order, *rest)]).select(rows.columns)


def counts_where(**conditions: Column) -> list[Column]:
    """One aggregate for each name: the rows where its condition holds."""
    return [F.count_if(condition).alias(name) for name, condition in conditions.items()]


def headline(text, words: list[str], fragments: int = 3, most: int = 35):
    """Fragments of up to `most` words around matches, matches in <mark>; null if there is none."""
    import re

    pattern = "(?iU)(?<![\\p{L}\\p{N}])(" + "|".join(map(re.escape, words)) + ")(?![\\p{L}\\p{N}])"
    if not words:
        return F.lit(None).cast("string")
    # From the start of a word on, and words whole: the first match never starts elsewhere, and a search does not go back into words.
    around = f"(?s)(?<!\\S)(?:\\S++\\s++){{0,{most // 2}}}\\S*?(?:{'|'.join(map(re.escape, words))})\\S*(?:\\s+\\S+){{0,{most // 2}}}"
    pieces = F.slice(F.regexp_extract_all(text, F.lit("(?iU)" + around), F.lit(0)), 1, fragments)
    marked = F.transform(pieces, lambda p: F.regexp_replace(p, pattern, "<mark>$1</mark>"))
    return F.when(text.rlike(pattern), F.array_join(marked, " … "))
