"""Quality rules, line first, in DataFrame functions only.

Every line with a word is judged on its own: navigation (separator bars), symbol
noise, shouting, missing punctuation in a long line, and boilerplate phrases. Failing
lines are removed; a document that loses more than half of its words is rejected, as
is one that fails the base rules (fewer than 20 words, or over 30 percent of them in
repeated 8-word windows).

A null or empty text has no words and fails the base rules; it is still one row of
the result. Repeated rows are judged each on its own. Only the named columns are
read, so extra columns never clash.

Repeated windows are found on 64-bit hashes within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS, REPEAT_SHARE, WINDOW = 20, 30, 8
#: Share of its words that a document may lose with its failing lines, in percent.
MOST_LOST = 50
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Fixed phrases of page furniture.
BOILERPLATE = "(?i)cookie policy|privacy policy|terms of (use|service)|all rights reserved|enable javascript|lorem ipsum|subscribe to our|sign up for|click here|read more|powered by|skip to content"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def line_fails(line: Column, n: Column) -> Column:
    """Whether a line of n > 0 words fails a rule."""
    bars, noise, loud = _count(line, "[|»›•]"), _count(line, r"[#*$%&<>{}\\^~=]"), _count(line, "[!]")
    return (
        ((bars >= 3) & (bars * 4 >= n))
        | ((noise >= 3) & (noise * 10 >= n * 3))
        | ((loud >= 3) & (loud * 10 >= n * 3))
        | ((n >= 30) & ~line.rlike("[.!?;:,…。]"))
        | ((n <= 30) & line.rlike(BOILERPLATE))
    )


def _repeat_words(hashes: Column) -> Column:
    """Words in windows that occur twice or more, from the hash of every window start."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twin(p: Column, k: Column, all_: Column) -> Column:
        return ((k > 0) & (F.get(all_, k - 1)["h"] == p["h"])) | F.coalesce(F.get(all_, k + 1)["h"] == p["h"], F.lit(False))

    def sum_up(all_: Column) -> Column:
        return F.array_sort(F.transform(F.filter(all_, lambda p, k: twin(p, k, all_)), lambda p: p["i"]))

    # One-element arrays bind a value to a name, so that it is computed once.
    starts = F.flatten(F.transform(F.array(pairs), sum_up))
    steps = F.flatten(F.transform(F.array(starts), lambda s: F.transform(s, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - p, F.lit(WINDOW))))))
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The op4 columns, then n_words_lost and the cleaned text, for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return _judged(rows)


def _judged(rows: DataFrame) -> DataFrame:
    """rows with text (not null) and whatever else, plus the verdict's columns."""
    rows = rows.withColumn("_words", words_of(F.col("text"))).withColumn("_n", F.size("_words"))
    rows = rows.withColumn("_lines", F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("x"), F.size(words_of(x)).alias("n"))))
    rows = rows.withColumn("_hashes", F.when(F.col("_n") > WINDOW, F.transform(F.sequence(F.lit(1), F.col("_n") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, F.lit(WINDOW))))).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("_full", F.transform(F.filter("_lines", lambda s: s["n"] > 0), lambda s: s["x"]))
    rows = rows.withColumn("_good", F.filter("_lines", lambda s: (s["n"] == 0) | ~line_fails(s["x"], s["n"])))
    rows = rows.withColumn("_kept", F.aggregate("_good", F.lit(0).cast("bigint"), lambda a, s: a + s["n"]))
    rows = rows.withColumn("_again", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), _repeat_words(F.col("_hashes"))).otherwise(F.lit(0).cast("bigint")))
    failed = (F.col("_n") < MIN_WORDS) | (F.col("_again") * 100 > F.col("_n") * REPEAT_SHARE)
    return rows.select(
        *[F.col(f"`{c}`") for c in rows.columns if not c.startswith("_")],
        F.col("_n").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("bigint").alias("n_dup_lines"),
        F.col("_again").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & ((F.col("_n") - F.col("_kept")) * 100 <= F.col("_n") * MOST_LOST)).alias("kept"),
        (F.col("_n") - F.col("_kept")).alias("n_words_lost"),
        F.array_join(F.transform("_good", lambda s: s["x"]), "\n").alias("clean_text"),
    )


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_lost")


def clean_documents(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """The kept documents without their failing lines; columns as they came, count_col is the new length."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # A plain filter would be pushed below the verdict and compute all of it again; a generator stays where it is.
    verdict = F.struct("row", "clean_text", "kept")
    kept = _judged(rows).select(F.inline(F.filter(F.array(verdict), lambda v: v["kept"])))

    def value(c: str) -> Column:
        if c == text_col:
            return F.col("clean_text")
        if c == count_col:
            return F.length("clean_text").cast(docs.schema[c].dataType)
        return F.col("row").getField(c)

    return kept.select(*[value(c).alias(c) for c in names])
