"""Artefact checks as one frame of (document_id, check, status, detail), and their rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OK, TODO, WARN, FAIL = "OK", "TODO", "WARN", "FAIL"
SEVERITY = {OK: 0, TODO: 1, WARN: 2, FAIL: 3}
#: Fixed thresholds.
PAGE_COVERAGE, TOKENS_LOW, TOKENS_HIGH, EMPTY_PAGES, DOMINANCE, DOMINANCE_CHUNKS, OUTLINE_WARN, OUTLINE_FAIL = 0.80, 60, 1500, 0.10, 0.30, 10, 0.05, 0.20


def severity(status: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), status)


def rollup(checks: DataFrame) -> DataFrame:
    """document_id and its worst status."""
    worst = checks.groupBy("document_id").agg(F.max(severity(F.col("status"))).alias("s"))
    names = F.array(*[F.lit(x) for x in SEVERITY])
    return worst.select("document_id", F.get(names, F.col("s")).alias("verdict"))


def triage(checks: DataFrame) -> DataFrame:
    """check, status, documents: what is wrong where, worst first."""
    return checks.where(F.col("status") != OK).groupBy("check", "status").agg(F.count_distinct("document_id").alias("documents")).orderBy(severity(F.col("status")).desc(), F.desc("documents"), "check")


def _row(name: str, status: Column, detail: Column):
    return "document_id", F.lit(name).alias("check"), status.alias("status"), detail.cast("string").alias("detail")


def chunk_checks(chunks: DataFrame, dimensions: int) -> DataFrame:
    """Chunk count, indexes, token range, vectors, section dominance, page coverage."""
    per = chunks.groupBy("document_id").agg(
        F.count("*").alias("n"),
        F.count_distinct("chunk_index").alias("distinct_n"),
        F.max("chunk_index").alias("last"),
        F.min("token_count").alias("low"),
        F.max("token_count").alias("high"),
        F.count_if((F.coalesce("content_kind", F.lit("prose")) != "annex") & F.col("embedding").isNull()).alias("bare"),
        F.sort_array(F.collect_set(F.size("embedding"))).alias("dims"),
        F.count_if(F.coalesce(F.trim("chunk_raw"), F.lit("")) == "").alias("blank"),
        F.avg(F.when(F.col("page_from").isNotNull(), 1.0).otherwise(0.0)).alias("paged"),
    )
    by_section = chunks.groupBy("document_id", F.coalesce("section", F.lit("")).alias("section")).agg(F.count("*").alias("k"))
    top = by_section.groupBy("document_id").agg(F.max("k").alias("k"))
    per = per.join(top, "document_id")
    wrong_dims = F.exists(F.filter("dims", lambda d: d >= 0), lambda d: d != dimensions)
    checks = [
        _row("chunks", F.when(F.col("n") > 0, OK).otherwise(FAIL), F.col("n")),
        _row("indexes", F.when((F.col("n") == F.col("distinct_n")) & (F.col("last") == F.col("n") - 1), OK).otherwise(FAIL), F.col("last")),
        _row("blank", F.when(F.col("blank") == 0, OK).otherwise(FAIL), F.col("blank")),
        _row("short", F.when(F.col("low") >= TOKENS_LOW, OK).otherwise(WARN), F.col("low")),
        _row("long", F.when(F.col("high") <= TOKENS_HIGH, OK).otherwise(FAIL), F.col("high")),
        _row("vectors", F.when(wrong_dims, FAIL).when(F.col("bare") > 0, TODO).otherwise(OK), F.col("bare")),
        _row("dominance", F.when((F.col("n") >= DOMINANCE_CHUNKS) & (F.col("k") / F.col("n") > DOMINANCE), WARN).otherwise(OK), F.col("k")),
        _row("pages", F.when(F.col("paged") >= PAGE_COVERAGE, OK).otherwise(WARN), F.round("paged", 3)),
    ]
    # One pass over the aggregate: every row becomes the array of its checks.
    each = F.explode(F.array(*[F.struct(*c[1:]) for c in checks]))
    return per.select("document_id", each.alias("c")).select("document_id", "c.*")


def page_checks(pages: DataFrame) -> DataFrame:
    per = pages.groupBy("document_id").agg(F.count("*").alias("n"), F.avg(F.when(F.coalesce(F.trim("text"), F.lit("")) == "", 1.0).otherwise(0.0)).alias("empty"))
    return per.select(*_row("empty pages", F.when(F.col("empty") <= EMPTY_PAGES, OK).otherwise(WARN), F.round("empty", 3)))


def outline_checks(outline: DataFrame, headings: DataFrame) -> DataFrame:
    """Share of contents entries (document_id, number) without a promoted heading."""
    missing = outline.join(headings, ["document_id", "number"], "left_anti").groupBy("document_id").agg(F.count("*").alias("m"))
    per = outline.groupBy("document_id").agg(F.count("*").alias("n")).join(missing, "document_id", "left")
    share = F.coalesce("m", F.lit(0)) / F.col("n")
    return per.select(*_row("outline", F.when(share > OUTLINE_FAIL, FAIL).when(share > OUTLINE_WARN, WARN).otherwise(OK), F.round(share, 3)))


def metadata_checks(documents: DataFrame, required: tuple[str, ...] = ("title", "report_type", "locality", "report_date", "author", "summary")) -> DataFrame:
    """Missing extraction fields, and a date that isn't one."""
    missing = F.filter(F.array(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in required]), lambda c: c.isNotNull())
    return documents.select(*_row("metadata", F.when(F.size(missing) == 0, OK).otherwise(WARN), F.array_join(missing, ", ")))


def manifest_checks(planned: DataFrame) -> DataFrame:
    return planned.select(F.col("document_id"), F.lit("manifest").alias("check"), F.when(F.size("stages") == 0, OK).otherwise(TODO).alias("status"), F.array_join("stages", ", ").alias("detail"))


def unconverted(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sources that no manifest entry names."""
    return sources.join(manifest.select(F.col("source_key").alias("path")), "path", "left_anti").select(F.col("stem").alias("document_id"), F.lit("converted").alias("check"), F.lit(TODO).alias("status"), F.col("name").alias("detail"))


def reconcile(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("document_id", "chunk_index"), text: str = "chunk_raw") -> DataFrame:
    """keys and difference: rows on one side only, or with another text."""
    a = left.select(*keys, F.sha2(text, 256).alias("_a"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.sha2(text, 256).alias("_b"), F.lit(True).alias("_r"))
    both = a.join(b, list(keys), "full_outer")
    kind = F.when(F.col("_r").isNull(), "missing right").when(F.col("_l").isNull(), "missing left").when(~F.col("_a").eqNullSafe(F.col("_b")), "differs")
    return both.select(*keys, kind.alias("difference")).where("difference is not null")


def trailing_runs(chunks: DataFrame) -> DataFrame:
    """document_id, run: how many last chunks share one section."""
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    changed = chunks.withColumn("_new", ~F.coalesce("section", F.lit("")).eqNullSafe(F.lag(F.coalesce("section", F.lit(""))).over(order)))
    per = changed.groupBy("document_id").agg(F.max(F.when(F.col("_new"), F.col("chunk_index"))).alias("a"), F.max("chunk_index").alias("b"))
    return per.select("document_id", (F.col("b") - F.col("a") + 1).alias("run"))


def table_totals(tables: DataFrame) -> DataFrame:
    return tables.groupBy("where").agg(F.count("*").alias("pages"), F.sum("rows").alias("rows")).orderBy("where")


def top_removals(removals: DataFrame, k: int = 8) -> DataFrame:
    """The k largest removals of each reason."""
    order = Window.partitionBy("reason").orderBy(F.desc("lines"), "detail")
    return removals.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def all_checks(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
