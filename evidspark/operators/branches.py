"""The ranked branches: strict full text, any-word full text and exact cosine similarity.

Every branch filters first, orders by a total order and keeps `fetch` rows, which Spark
runs as a top-k per partition. Scores are rounded before they order.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidspark.functions.text import dot, fold_value, norm
from evidspark.operators.index import chunk_tokens, describe, idf, lexemes_of, match, mentioning, parse_websearch, query_words


def fts(chunks: DataFrame, query: str, fetch: int, stop_words: Iterable[str] = (), allowed: DataFrame | None = None) -> DataFrame:
    """chunk_id, document_id, chunk_index, score of chunks that match all of the query, best first."""
    base = chunks if allowed is None else chunks.join(allowed, "document_id", "left_semi")
    groups = parse_websearch(query, stop_words)
    tokens = chunk_tokens(mentioning(base, [w for g in groups for i in g for w in i.words]))
    ids = base.select("chunk_id", "document_id", "chunk_index")
    return match(tokens, groups, ids).join(ids, "chunk_id").orderBy(F.desc("score"), "document_id", "chunk_index", "chunk_id").limit(fetch)


def terms(query: str, stop_words: Iterable[str] = ()) -> list[tuple[str, ...]]:
    """Distinct terms of a query: each word's lexemes, without words that are only stop words."""
    stop = {fold_value(w) for w in stop_words}
    out = []
    for w in query_words(query):
        found = lexemes_of(w)
        if found and not all(x in stop for x in found):
            out.append(found)
    return list(dict.fromkeys(out))


def any_word(chunks: DataFrame, query: str, stop_words: Iterable[str] = ()) -> DataFrame:
    """chunk_id, score (sum of the idf of distinct matched terms) and rank (sum of ln(1 + tf)); the statistics are of all chunks, whatever is filtered later."""
    found = terms(query, stop_words)
    if not found:
        return chunks.select("chunk_id", F.lit(0.0).alias("score"), F.lit(0.0).alias("rank")).limit(0)
    words = sorted({w for t in found for w in t})
    hits = chunk_tokens(mentioning(chunks, words)).where(F.col("lexeme").isin(*words)).groupBy("chunk_id").agg(*[F.collect_list(F.when(F.col("lexeme") == w, F.col("pos"))).alias(f"p_{k}") for k, w in enumerate(words)])

    def at(term: tuple[str, ...]):
        place = F.col(f"p_{words.index(term[0])}")
        for k, w in enumerate(term[1:], 1):
            place = F.array_intersect(place, F.transform(F.col(f"p_{words.index(w)}"), _back(k)))
        return F.size(place)

    per_term = hits.select("chunk_id", F.explode(F.array(*[F.struct(F.lit(k).alias("term"), at(t).alias("tf")) for k, t in enumerate(found)])).alias("x")).select("chunk_id", "x.*").where("tf > 0")
    total = chunks.agg(F.count("*").alias("n"))
    weights = per_term.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select("term", idf(F.col("n"), F.col("df")).alias("idf"))  # one row each side: at most 32 terms, one total
    scored = per_term.join(F.broadcast(weights), "term")
    return scored.groupBy("chunk_id").agg(F.round(F.sum("idf"), 6).alias("score"), F.round(F.sum(F.log1p("tf")), 6).alias("rank"))


def _back(k: int):
    return lambda p: p - k


def fts_any(chunks: DataFrame, query: str, fetch: int, stop_words: Iterable[str] = (), allowed: DataFrame | None = None) -> DataFrame:
    """Chunks with any word of the query, by summed idf."""
    ids = chunks if allowed is None else chunks.join(allowed, "document_id", "left_semi")
    out = any_word(chunks, query, stop_words).join(ids.select("chunk_id", "document_id", "chunk_index"), "chunk_id")
    return out.orderBy(F.desc("score"), F.desc("rank"), "document_id", "chunk_index", "chunk_id").limit(fetch)


def vector(chunks: DataFrame, query: Sequence[float], fetch: int, allowed: DataFrame | None = None) -> DataFrame:
    """Cosine similarity over chunks that have a vector; chunk_id settles ties."""
    literal = F.array(*[F.lit(round(float(x), 6)) for x in query])
    length = sum(round(float(x), 6) ** 2 for x in query) ** 0.5
    base = chunks.where(F.col("embedding").isNotNull())
    base = base if allowed is None else base.join(allowed, "document_id", "left_semi")
    cosine = F.round(dot(F.col("embedding"), literal) / (norm(F.col("embedding")) * F.lit(length)), 6)
    return base.select("chunk_id", "document_id", "chunk_index", cosine.alias("score")).orderBy(F.desc("score"), "chunk_id").limit(fetch)


def lexical_match(hits: DataFrame, chunks: DataFrame, query: str, stop_words: Iterable[str] = ()) -> DataFrame:
    """hits plus whether each holds any word of the query."""
    matched = any_word(chunks.join(hits.select("chunk_id"), "chunk_id", "left_semi"), query, stop_words).select("chunk_id", F.lit(True).alias("lexical_match"))
    return hits.join(matched, "chunk_id", "left").withColumn("lexical_match", F.coalesce("lexical_match", F.lit(False)))


def debug_lexemes(query: str, stop_words: Iterable[str] = ()) -> dict[str, str]:
    """The query trees of both configurations and of the any-word branch."""
    return {"stem": describe(parse_websearch(query, stop_words)), "literal": describe(parse_websearch(query)), "any": " | ".join(" <-> ".join(f"'{w}'" for w in t) for t in terms(query, stop_words))}
