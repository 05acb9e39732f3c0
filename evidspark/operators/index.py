"""Full-text index: postings of two configurations, document frequencies and the query tree.

`stem` folds accents, applies the stemmer and drops stop words; `literal` only folds.
A query matches if either configuration matches. A lemma table (form, lemma), n to m,
may stand in for the stemmer; without one, words are their own stems.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidspark.functions.text import fold, fold_value, tokens

MAX_WORDS = 32
Stemmer = Callable[[Column], Column]


def chunk_tokens(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "chunk_raw") -> DataFrame:
    """chunk_id, pos, lexeme (literal) for every token."""
    return chunks.select(F.col(id_col).alias("chunk_id"), F.posexplode(tokens(F.col(text_col))).alias("pos", "lexeme"))


def mentioning(chunks: DataFrame, words: Iterable[str], text_col: str = "chunk_raw") -> DataFrame:
    """Chunks whose folded text holds any of the words, even inside others; the rest need no tokens."""
    import re

    pattern = "|".join(re.escape(w) for w in sorted(set(words)))
    return chunks.where(fold(F.col(text_col)).rlike(pattern)) if pattern else chunks


def stems(literal: DataFrame, stop_words: Iterable[str] = (), stemmer: Stemmer | None = None, lemmas: DataFrame | None = None) -> DataFrame:
    """The stem configuration of (chunk_id, pos, lexeme)."""
    words = sorted({fold_value(w) for w in stop_words})
    out = literal.where(~F.col("lexeme").isin(*words)) if words else literal
    if lemmas is not None:
        table = lemmas.select(F.col("form").alias("lexeme"), "lemma")
        return out.join(table, "lexeme", "left").select("chunk_id", "pos", F.coalesce("lemma", "lexeme").alias("lexeme"))
    return out.withColumn("lexeme", stemmer(F.col("lexeme"))) if stemmer else out


def postings(positions: DataFrame) -> DataFrame:
    """chunk_id, lexeme, tf, positions."""
    return positions.groupBy("chunk_id", "lexeme").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def chunk_postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "chunk_raw") -> DataFrame:
    """postings() of the tokens of chunks: a chunk's text moves once, to the other rows of its id, and no token leaves its chunk's row."""
    rows = chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("text")).repartition("chunk_id")
    texts = rows.groupBy("chunk_id").agg(F.collect_list("text").alias("texts"))
    placed = F.flatten(F.transform("texts", lambda t: F.transform(tokens(t), lambda x, i: F.struct(x.alias("lexeme"), i.alias("pos")))))
    pairs = texts.select("chunk_id", F.sort_array(placed).alias("pairs"))
    n = F.size("pairs")

    def opens(i: Column) -> Column:
        return (i < n) & ((i == 0) | (F.get("pairs", i)["lexeme"] != F.get("pairs", i - 1)["lexeme"]))

    runs = pairs.withColumn("starts", F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), opens))

    def run(start: Column, k: Column) -> Column:
        tf = F.coalesce(F.get("starts", k + 1), n) - start
        return F.struct(F.get("pairs", start)["lexeme"].alias("lexeme"), tf.cast("bigint").alias("tf"), F.slice("pairs", start + 1, tf)["pos"].alias("positions"))

    return runs.select("chunk_id", F.explode(F.transform("starts", run)).alias("p")).select("chunk_id", "p.*")


def write_postings(positions: DataFrame, path: str, buckets: int = 256) -> None:
    """A stored index: files by lexeme bucket, sorted, so that a query reads a few row groups of a few buckets."""
    out = positions.groupBy("lexeme", "chunk_id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    out = out.withColumn("bucket", F.pmod(F.xxhash64("lexeme"), F.lit(buckets)).cast("int"))
    out.repartition("bucket", "lexeme").sortWithinPartitions("bucket", "lexeme", "chunk_id").write.partitionBy("bucket").parquet(path)


def document_frequency(positions: DataFrame) -> DataFrame:
    """lexeme, df: chunks that hold it. Distinct pairs first, so a common lexeme meets as partial counts."""
    return positions.select("lexeme", "chunk_id").distinct().groupBy("lexeme").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def query_words(text: str, most: int = MAX_WORDS) -> list[str]:
    """Words without quotes, operators and repeats, in order."""
    out = []
    for w in text.split():
        w = w.replace('"', "").lstrip("-")
        if w and w.lower() != "or":
            out.append(w)
    return list(dict.fromkeys(out))[:most]


@dataclass(frozen=True)
class Item:
    """A word, or a phrase of several, possibly negated."""

    words: tuple[str, ...]
    negated: bool = False


def lexemes_of(word: str) -> tuple[str, ...]:
    """Folded letter and digit runs of a word; `HV-106/2` is a phrase of three."""
    import regex

    return tuple(regex.findall(r"[\p{L}\p{N}]+", fold_value(word)))


def parse_websearch(text: str, stop_words: Iterable[str] = ()) -> list[list[Item]]:
    """Alternatives of conjunctions: quotes are phrases, `or` separates, a leading dash negates. Never raises."""
    import re

    stop = {fold_value(w) for w in stop_words}
    groups: list[list[Item]] = [[]]
    for dash, phrase, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', text):
        if word.lower() == "or" and not dash:
            groups.append([])
            continue
        negated = bool(dash)
        while word.startswith("-"):
            word, negated = word[1:], True
        words = tuple(x for w in (phrase or word).split() for x in lexemes_of(w) if x not in stop)
        if words:
            groups[-1].append(Item(words, negated))
    return [g for g in groups if g]


def describe(groups: list[list[Item]]) -> str:
    """The query tree as text, for traces."""
    def one(i: Item) -> str:
        return ("!" if i.negated else "") + " <-> ".join(f"'{w}'" for w in i.words)

    return " | ".join(" & ".join(map(one, g)) for g in groups)


def match(positions: DataFrame, groups: list[list[Item]], everything: DataFrame | None = None) -> DataFrame:
    """chunk_id and score (sum of ln(1 + tf) over the query's positive lexemes) of matching chunks.

    Only tokens of the query pass the filter, before anything is shuffled. A query that may
    match chunks without any of its words needs `everything`, a frame of all chunk ids.
    """
    words = list(dict.fromkeys(w for g in groups for i in g for w in i.words))
    if not words:
        return positions.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    place = {w: f"p{k}" for k, w in enumerate(words)}
    found = positions.where(F.col("lexeme").isin(*words)).groupBy("chunk_id").agg(*[F.collect_list(F.when(F.col("lexeme") == w, F.col("pos"))).alias(c) for w, c in place.items()])
    if any(all(i.negated for i in g) for g in groups):
        if everything is None:
            raise ValueError("a query of negations alone needs all chunk ids")
        found = everything.select("chunk_id").join(found, "chunk_id", "left").select("chunk_id", *[F.coalesce(c, F.array().cast("array<int>")).alias(c) for c in place.values()])

    def holds(i: Item) -> Column:
        at = F.col(place[i.words[0]])
        for k, w in enumerate(i.words[1:], 1):
            at = F.array_intersect(at, F.transform(F.col(place[w]), _back(k)))
        return F.size(at) == 0 if i.negated else F.size(at) > 0

    condition = F.lit(False)
    for g in groups:
        own = F.lit(True)
        for i in g:
            own = own & holds(i)
        condition = condition | own
    positive = list(dict.fromkeys(w for g in groups for i in g if not i.negated for w in i.words))
    score = sum((F.log1p(F.size(place[w])) for w in positive), F.lit(0.0))
    return found.where(condition).select("chunk_id", F.round(score, 6).alias("score"))


def _back(k: int) -> Callable[[Column], Column]:
    return lambda p: p - k
