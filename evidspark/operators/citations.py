"""Quote and number checks of an answer's statements against the sources they cite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidspark.functions.text import contains_normalized, normalize_for_match, numbers_in, states_number

HEADER = ("title", "municipality", "report_type", "organization", "report_date")
VERDICTS = ("verified", "unsupported", "invalid_source", "quote_not_found", "number_unsupported")


def check(statements: DataFrame, sources: DataFrame) -> DataFrame:
    """statements (answer_id, statement_id, text, source_ids, quotes) plus `check`.

    In this order: a cited id is unknown; no ids or no quotes; a quote is in no cited
    chunk; a number of the sentence is in no cited chunk or document header.
    """
    quotes = F.filter(F.coalesce("quotes", F.array().cast("array<string>")), lambda q: F.trim(q) != "")
    rows = statements.withColumns({"_ids": F.array_distinct(F.coalesce("source_ids", F.array().cast("array<int>"))), "_quotes": F.transform(quotes, lambda q: normalize_for_match(q)), "_numbers": numbers_in(normalize_for_match(F.col("text")))})
    text = normalize_for_match(F.col("chunk_raw"))
    header = normalize_for_match(F.concat_ws(" ", "chunk_raw", *[F.col(c).cast("string") for c in HEADER]))
    known = sources.select("answer_id", F.col("id").alias("_id"), text.alias("_text"), header.alias("_header"))
    cited = rows.select("answer_id", "statement_id", "_quotes", "_numbers", F.explode("_ids").alias("_id")).join(known, ["answer_id", "_id"], "left")
    seen = cited.groupBy("answer_id", "statement_id").agg(
        F.bool_or(F.col("_text").isNull()).alias("_unknown"),
        F.flatten(F.collect_list(F.filter("_quotes", lambda q: contains_normalized(F.col("_text"), q)))).alias("_found"),
        F.array_join(F.array_sort(F.collect_list("_header")), " ").alias("_all"),
    )
    out = rows.join(seen, ["answer_id", "statement_id"], "left")
    missing_quote = F.size(F.array_except("_quotes", "_found")) > 0
    missing_number = F.exists("_numbers", lambda n: ~states_number(F.col("_all"), n))
    verdict = (
        F.when(F.coalesce("_unknown", F.lit(False)), "invalid_source")
        .when((F.size("_ids") == 0) | (F.size("_quotes") == 0), "unsupported")
        .when(missing_quote | F.exists("_quotes", lambda q: q == ""), "quote_not_found")
        .when(missing_number, "number_unsupported")
        .otherwise("verified")
    )
    return out.withColumn("check", verdict).drop("_ids", "_quotes", "_numbers", "_unknown", "_found", "_all")


def summarize(checked: DataFrame) -> DataFrame:
    """answer_id, statements, verified, flagged, one count a verdict, cited_sources."""
    return checked.groupBy("answer_id").agg(
        F.count("*").alias("statements"),
        F.count_if(F.col("check") != "verified").alias("flagged"),
        *[F.count_if(F.col("check") == v).alias(v) for v in VERDICTS],
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("source_ids", F.array().cast("array<int>")))))).alias("cited_sources"),
    )


def final_status(answers: DataFrame, summary: DataFrame) -> DataFrame:
    """answers (answer_id, model_status) plus status."""
    n, ok = F.coalesce("statements", F.lit(0)), F.coalesce("verified", F.lit(0))
    status = (
        F.when((n == 0) & (F.col("model_status") == "answered"), "insufficient")
        .when(n == 0, F.col("model_status"))
        .when(ok == 0, "insufficient")
        .when(ok < n, "partial")
        .otherwise(F.col("model_status"))
    )
    return answers.join(summary.select("answer_id", "statements", "verified"), "answer_id", "left").withColumn("status", status).drop("statements", "verified")
