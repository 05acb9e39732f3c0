"""Registered queries of grading, evidence, citations, evaluation, structure, state and quality, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidspark.functions import text as tx
from evidspark.operators import chunking, citations, context, evaluation, grading, pages, quality_checks, structure
from evidspark.plans.corpus import SQL_DOCUMENTS, SQL_LINES, chunks, documents, line_chunks, table
from evidspark.sources import state
from evidspark.streaming import log

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
SQL: dict[str, str] = {}
_GRADED = """graded AS (SELECT d.doc_id AS chunk_id, d.doc_id AS document_id, row_number() OVER (ORDER BY d.doc_id) AS candidate_rank,
 coalesce(quality * 2 + (1 - toxic), 0) AS rerank_grade, source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def query(sql: str | None = None) -> Callable[[Q], Q]:
    def register(f: Q) -> Q:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), (F.col("quality") * 2 + (1 - F.col("toxic"))).alias("grade"), F.lit("label").alias("reason"), F.lit(0).alias("ordinal"))


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), "source")
    return grading.align(hits, _grades(spark, sf_dir))


# --- grading and the gate -------------------------------------------------------------


@query("SELECT chunk_id, coalesce(least(3, greatest(0, g)), 0) AS rerank_grade, CASE WHEN g IS NULL THEN '' ELSE 'a b' END AS rerank_reason FROM (SELECT doc_id AS chunk_id FROM documents) LEFT JOIN (SELECT doc_id AS chunk_id, quality * 5 - toxic AS g FROM labels) USING (chunk_id)")
def align_grades(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    first = labels.select(F.col("doc_id").alias("chunk_id"), (F.col("quality") * 5 - F.col("toxic")).alias("grade"), F.lit(" a \n b ").alias("reason"), F.lit(0).alias("ordinal"))
    again = first.withColumns({"grade": F.lit(1), "ordinal": F.lit(1)})
    unknown = first.withColumn("chunk_id", -F.col("chunk_id") - 1)
    hits = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"))
    return grading.align(hits, first.unionByName(again).unionByName(unknown))


@query(f"WITH {_GRADED} SELECT source, chunk_id, rerank_grade, row_number() OVER (PARTITION BY source ORDER BY rerank_grade DESC, chunk_id) AS place FROM graded")
def rerank_order(spark, sf_dir):
    placed = grading.order_by_grade(_graded(spark, sf_dir), ("source",), "chunk_id")
    return placed.select("source", "chunk_id", "rerank_grade", F.col("rerank_rank").alias("place"))


@query(f"WITH {_GRADED} SELECT chunk_id, rerank_grade FROM graded WHERE rerank_grade IS NULL OR rerank_grade >= 2")
def gate_pass(spark, sf_dir):
    return _graded(spark, sf_dir).where(grading.passes_gate(F.col("rerank_grade"))).select("chunk_id", "rerank_grade")


@query("SELECT (turn // 20)::int AS batch, count(*) AS n, min(conv_id) AS first FROM conversations GROUP BY 1")
def grading_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", grading.batch_of(F.col("turn") + 1).alias("batch"))
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"))


@query("SELECT event_type, sum(coalesce(CASE WHEN event_id % 3 > 0 THEN event_id END, 0))::bigint AS total_tokens FROM events GROUP BY 1")
def usage_sum(spark, sf_dir):
    tokens = F.when(F.col("event_id") % 3 > 0, F.col("event_id"))
    return grading.add_usage(table(spark, sf_dir, "events").withColumn("total_tokens", tokens), ("total_tokens",), ("event_type",))


@query()
def grading_prompts(spark, sf_dir):
    """Every document is a candidate: one list for each block of 40 ids, which makes two batches."""
    rows = table(spark, sf_dir, "documents").withColumn("question_id", F.expr("doc_id div 40"))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy("doc_id"))
    rows = rows.select("question_id", F.col("doc_id").alias("chunk_id"), rank.alias("candidate_rank"), F.col("source").alias("section"), F.col("text").alias("chunk_raw"))
    return grading.prompts(rows, "what is <this>?", ("question_id",))


# --- evidence --------------------------------------------------------------------------


@query(f"WITH {_GRADED}, c AS (SELECT lang AS question_id, d.source AS document_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents d) SELECT *  FROM (SELECT *, row_number() OVER (PARTITION BY question_id, document_id ORDER BY rank) AS document_place FROM c) WHERE document_place <= 3")
def per_document_cap(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("question_id"), F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_id"), F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")).alias("rank"))
    return context.per_document_cap(rows)


def _pack_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document is a candidate; one question for each block of 8 ids."""
    rows = line_chunks(spark, sf_dir).withColumns({"chunk_id": F.concat_ws(":", F.col("document_id").cast("string"), F.col("chunk_index").cast("string")), "question_id": F.expr("document_id div 8")})
    return rows.select(
        "question_id", "document_id", "chunk_id", "chunk_index", "section",
        F.row_number().over(Window.partitionBy("question_id").orderBy(F.xxhash64("chunk_id"), "chunk_id")).alias("rank"),
        (F.col("token_count") * 10).cast("int").alias("cost"), (F.col("chunk_index") % 4).alias("rerank_grade"), "token_count", "chunk_raw",
    )


@query()
def context_budget_pack(spark, sf_dir):
    return context.pack(_pack_input(spark, sf_dir))


@query()
def context_neighbours(spark, sf_dir):
    chosen = context.pack(_pack_input(spark, sf_dir), carry=("chunk_index", "section", "rerank_grade"))
    every = line_chunks(spark, sf_dir).withColumn("chunk_id", F.concat_ws(":", F.col("document_id").cast("string"), F.col("chunk_index").cast("string")))
    return context.number_sources(context.add_neighbours(chosen, every))


@query(f"WITH {_GRADED}, s AS (SELECT lang AS question_id, source AS document_id, doc_id AS chunk_id, doc_id AS chunk_index, doc_id % 4 AS rerank_grade, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS position FROM documents), k AS (SELECT *, max(rerank_grade) OVER w AS best, min(position) OVER w AS first FROM s WINDOW w AS (PARTITION BY question_id, document_id)) SELECT question_id, document_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY best DESC, first, document_id, chunk_index) AS id FROM k")
def source_numbering(spark, sf_dir):
    position = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("doc_id")))
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("question_id"), F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("chunk_index"), (F.col("doc_id") % 4).alias("rerank_grade"), position.alias("position"))
    return context.number_sources(rows).select("question_id", "document_id", "chunk_id", "id")


@query()
def rendered_context(spark, sf_dir):
    numbered = source_numbering(spark, sf_dir).where("id <= 8").withColumnRenamed("document_id", "organization")
    body = chunks(spark, sf_dir).select("chunk_id", "document_id", "section", "chunk_raw")
    meta = documents(spark, sf_dir).select("document_id", "title", "municipality", "report_type", "report_date")
    full = numbered.join(body, "chunk_id").join(meta, "document_id")
    return context.render(full.withColumns({"content_kind": F.lit("prose"), "role": F.lit(context.FOUND), "page_from": F.lit(1), "page_to": F.lit(2)}))


# --- citations -------------------------------------------------------------------------


def _statements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Statements quote the first line of a document; every third cites another document, every seventh none."""
    docs = table(spark, sf_dir, "documents")
    first = F.get(F.split("text", "\n"), F.lit(0))
    ids = F.when(F.col("doc_id") % 7 == 0, F.array().cast("array<int>")).when(F.col("doc_id") % 11 == 0, F.array(F.lit(2))).otherwise(F.array(F.lit(1)))
    quote = F.when(F.col("doc_id") % 3 == 0, F.lit("such words occur nowhere")).otherwise(first)
    claims = docs.select(F.col("doc_id").alias("answer_id"), F.lit(1).alias("statement_id"), F.concat(F.lit("It says so in "), (F.col("doc_id") % 2000).cast("string"), F.lit(" words.")).alias("text"), ids.alias("source_ids"), F.array(quote).alias("quotes"))
    sources = docs.select(F.col("doc_id").alias("answer_id"), F.lit(1).alias("id"), F.col("text").alias("chunk_raw"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("municipality"), F.col("lang").alias("report_type"), F.col("source").alias("organization"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("no "), (F.col("doc_id") % 2000).cast("string"))).alias("report_date"))
    return claims, sources


@query()
def quote_number_check(spark, sf_dir):
    return citations.check(*_statements(spark, sf_dir)).select("answer_id", "statement_id", "check")


def _norm_sql(c: str) -> str:
    return rf"lower(trim(regexp_replace(regexp_replace({c}, '[\s\x{{00A0}}]+', ' ', 'g'), ' ?- ?', '-', 'g')))"


@query(f"SELECT doc_id AS answer_id, contains({_norm_sql('text')}, {_norm_sql('q')}) AND length({_norm_sql('q')}) > 0 AS found FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'such words  occur nowhere' ELSE string_split(text, chr(10))[1] END AS q FROM documents)")
def quote_check(spark, sf_dir):
    first = F.get(F.split("text", "\n"), F.lit(0))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.lit("such words  occur nowhere")).otherwise(first).alias("q"))
    return rows.select(F.col("doc_id").alias("answer_id"), tx.contains_normalized(tx.normalize_for_match(F.col("text")), tx.normalize_for_match(F.col("q"))).alias("found"))


@query()
def number_check(spark, sf_dir):
    hay = tx.normalize_for_match(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", hay.alias("hay"), tx.numbers_in(hay).alias("numbers"))
    return rows.where(F.size("numbers") > 0).select("doc_id", "numbers", F.forall("numbers", lambda n: tx.states_number(F.col("hay"), n)).alias("all_stated"))


@query("SELECT answer_id, CASE WHEN n = 0 AND model_status = 'answered' THEN 'insufficient' WHEN n = 0 THEN model_status WHEN ok = 0 THEN 'insufficient' WHEN ok < n THEN 'partial' ELSE model_status END AS status FROM (SELECT user_id AS answer_id, CASE WHEN user_id % 2 = 0 THEN 'answered' ELSE 'partial' END AS model_status, count(*) FILTER (event_type <> 'view') AS n, count(*) FILTER (event_type = 'click') AS ok FROM events GROUP BY 1)")
def final_status(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    answers = events.select(F.col("user_id").alias("answer_id")).distinct().withColumn("model_status", F.when(F.col("answer_id") % 2 == 0, "answered").otherwise("partial"))
    summary = events.where("event_type <> 'view'").groupBy(F.col("user_id").alias("answer_id")).agg(F.count("*").alias("statements"), F.count_if(F.col("event_type") == "click").alias("verified"))
    return citations.final_status(answers, summary).select("answer_id", "status")


@query()
def citation_summary(spark, sf_dir):
    return citations.summarize(citations.check(*_statements(spark, sf_dir)))


# --- evaluation ------------------------------------------------------------------------

_NORM_DOC = _norm_sql("text")
_MATCH = f"hits AS (SELECT b.item_id AS id, d.doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains({_norm_sql('d.text')}, {_norm_sql('b.text')})), ranked AS (SELECT doc_id AS chunk_id, doc_id % 97 + 1 AS rank FROM documents)"
_EVAL = f"{_MATCH}, first AS (SELECT b.item_id AS id, CASE WHEN b.item_id % 2 = 0 THEN 'exact' ELSE 'multi' END AS type, min(rank) AS rank FROM benchmark b LEFT JOIN hits h ON h.id = b.item_id LEFT JOIN ranked USING (chunk_id) GROUP BY 1, 2)"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, chunk_id of benchmark items that a document holds word for word.

    Items meet documents on their first five words, an equality; containment is checked on the pairs that are left.
    """
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), tx.normalize_for_match(F.col("text")).alias("needle")).where("needle <> ''")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), tx.normalize_for_match(F.col("text")).alias("hay"))
    words = F.split("needle", " ")
    # An item inside a longer word still shares the words after its first; short items use what they have.
    items = items.withColumn("key", F.array_join(F.slice(words, 2, 4), " ")).withColumn("n", F.size(words))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 3)), lambda i: F.array_join(F.slice("w", i, 4), " "))
    keyed = docs.withColumn("w", F.split("hay", " ")).select("chunk_id", "hay", F.explode(F.array_distinct(grams)).alias("key"))
    long_ = items.where("n >= 6")
    pairs = keyed.join(long_, "key").where(F.contains("hay", "needle")).select("id", "chunk_id")
    short = items.where("n < 6").select("id", "needle")
    few = docs.join(short, F.contains("hay", "needle")).select("id", "chunk_id")
    return pairs.unionByName(few).distinct()


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 97 + 1).alias("rank"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.when(F.col("item_id") % 2 == 0, "exact").otherwise("multi").alias("type"))
    found = _evidence(spark, sf_dir).join(ranked, "chunk_id").groupBy("id").agg(F.min("rank").alias("rank"))
    return items.join(found, "id", "left").withColumn("mode", F.lit("fixed"))


@query(f"WITH {_MATCH} SELECT id, chunk_id FROM hits")
def evidence_matches(spark, sf_dir):
    return _evidence(spark, sf_dir)


@query(f"WITH {_EVAL} SELECT id, type, rank FROM first")
def evidence_ranks(spark, sf_dir):
    return _ranks(spark, sf_dir).select("id", "type", "rank")


@query(f"WITH {_EVAL}, q AS (SELECT type, CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END AS r5, CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END AS r10, CASE WHEN rank <= 40 THEN 1.0 ELSE 0 END AS r40, coalesce(1.0 / rank, 0) AS rr FROM first) SELECT 'fixed' AS mode, coalesce(type, 'all') AS type, count(*) AS questions, round(avg(r5), 6) AS recall_5, round(avg(r10), 6) AS recall_10, round(avg(r40), 6) AS recall_40, round(avg(rr), 6) AS mrr FROM q GROUP BY GROUPING SETS ((), (type))")
def recall_mrr(spark, sf_dir):
    return evaluation.summarize(evaluation.per_question(_ranks(spark, sf_dir)))


@query(f"WITH {_MATCH} SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT id FROM hits)")
def negatives_report(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id"))
    return items.join(_evidence(spark, sf_dir).select(F.col("id").alias("item_id")), "item_id", "left_anti")


@query(f"WITH {_MATCH}, {_GRADED}, p AS (SELECT b.item_id, count(chunk_id) > 0 AS answerable, count(*) FILTER (rerank_grade >= 2) > 0 AS passed FROM benchmark b LEFT JOIN hits h ON h.id = b.item_id LEFT JOIN graded USING (chunk_id) GROUP BY 1) SELECT count(*) FILTER (answerable) AS answerable, count(*) FILTER (answerable AND passed) AS relevant_passed, count(*) FILTER (NOT answerable) AS negatives FROM p")
def gate_summary(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    graded = _graded(spark, sf_dir).select("chunk_id", "rerank_grade")
    per = items.join(_evidence(spark, sf_dir).join(graded, "chunk_id"), "id", "left").groupBy("id").agg(F.count("chunk_id").alias("n"), F.count_if(F.col("rerank_grade") >= 2).alias("p"))
    return per.agg(F.count_if(F.col("n") > 0).alias("answerable"), F.count_if(F.col("p") > 0).alias("relevant_passed"), F.count_if(F.col("n") == 0).alias("negatives"))


@query("SELECT event_type, list_sort(list(value))[count(*)::int // 2 + 1] AS median FROM events GROUP BY 1")
def upper_median(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(evaluation.upper_median("value").alias("median"))


@query("SELECT event_type, round(quantile_cont(gap, 0.5), 6) AS median_gap FROM (SELECT event_type, lead(event_id) OVER (PARTITION BY event_type ORDER BY event_id) - event_id AS gap FROM events) WHERE gap IS NOT NULL GROUP BY 1")
def median_gap(spark, sf_dir):
    gap = F.lead("event_id").over(Window.partitionBy("event_type").orderBy("event_id")) - F.col("event_id")
    return table(spark, sf_dir, "events").select("event_type", gap.alias("gap")).where("gap is not null").groupBy("event_type").agg(F.round(F.expr("percentile(gap, 0.5)"), 6).alias("median_gap"))


# --- pages and structure ---------------------------------------------------------------

_PAGES = r"""f AS (SELECT doc_id AS document_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l, regexp_extract_all(strip_accents(lower(text)), '\p{L}{2,}') AS w FROM documents),
 g AS (SELECT document_id, len(l) AS lines, CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: length(x) >= 45)) / len(l) END AS long_share, CASE WHEN len(l) > 0 THEN coalesce(len(list_filter(w, lambda x: x IN ('the', 'of', 'que', 'der', 'is', 'se'))) / nullif(len(w), 0), 0) END AS stop_share FROM f)"""
_WORDS = ["the", "of", "que", "der", "is", "se"]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")


@query(f"WITH {_PAGES} SELECT document_id, lines, round(long_share, 6) AS long_share, round(stop_share, 6) AS stop_share FROM g")
def page_features(spark, sf_dir):
    return pages.features(_pages(spark, sf_dir), stop_words=_WORDS).select("document_id", "lines", F.round("long_share", 6).alias("long_share"), F.round("stop_share", 6).alias("stop_share"))


@query(f"WITH {_PAGES} SELECT document_id, CASE WHEN long_share IS NULL THEN 'empty' WHEN long_share < 0.12 AND stop_share < 0.06 THEN 'form' ELSE 'prose' END AS kind FROM g")
def page_kind(spark, sf_dir):
    return pages.features(_pages(spark, sf_dir), stop_words=_WORDS).select("document_id", pages.kind_of(F.col("long_share"), F.col("stop_share")).alias("kind"))


@query()
def cover_and_smoothing(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("page_no"), "text")
    return pages.classify(rows)


@query(f"WITH {SQL_LINES}, k AS (SELECT document_id % 20 AS d, regexp_replace(trim(regexp_replace(chunk_raw, '\\s+', ' ', 'g')), '\\s*[0-9]{{1,4}}$', '') AS key, length(trim(regexp_replace(chunk_raw, '\\s+', ' ', 'g'))) AS n FROM lines) SELECT d AS document_id, key, count(*) AS n FROM k WHERE n BETWEEN 1 AND 160 AND length(key) >= 3 AND regexp_matches(key, '\\p{{L}}{{3,}}') GROUP BY 1, 2 HAVING count(*) >= 4")
def furniture_signatures(spark, sf_dir):
    lines = line_chunks(spark, sf_dir).select((F.col("document_id") % 20).alias("document_id"), F.col("chunk_raw").alias("line"))
    counts = lines.select("document_id").distinct().withColumn("pages", F.lit(8))
    return pages.furniture(lines, counts)


@query()
def furniture_stripped(spark, sf_dir):
    lines = line_chunks(spark, sf_dir).select((F.col("document_id") % 20).alias("document_id"), F.col("chunk_raw").alias("line"), F.col("document_id").alias("page"), "chunk_index")
    counts = lines.select("document_id").distinct().withColumn("pages", F.lit(8))
    return pages.strip_furniture(lines, pages.furniture(lines, counts))


_HEAD = r"""heads AS (SELECT page_id AS document_id, unnest(range(len(h))) AS ordinal, CAST(unnest(list_transform(h, lambda x: x[3:3])) AS INTEGER) AS level, unnest(list_transform(h, lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g')))) AS title FROM (SELECT page_id, regexp_extract_all(html, '<h[1-6][^>]*>[^<]*</h[1-6]>') AS h FROM pages))"""


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit("<h[1-6][^>]*>[^<]*</h[1-6]>"), F.lit(0))
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("document_id"), F.posexplode(found).alias("ordinal", "tag"))
    return rows.select("document_id", "ordinal", F.substring("tag", 3, 1).cast("int").alias("level"), F.trim(F.regexp_replace("tag", "<[^>]*>", "")).alias("title"))


@query(f"WITH RECURSIVE {_HEAD}, chain AS (SELECT document_id, ordinal AS leaf, ordinal AS top, level, title AS path FROM heads UNION ALL SELECT c.document_id, leaf, h.ordinal, h.level, h.title || ' > ' || path FROM chain c JOIN heads h ON h.document_id = c.document_id AND h.ordinal = (SELECT max(x.ordinal) FROM heads x WHERE x.document_id = c.document_id AND x.ordinal < c.top AND x.level < c.level)) SELECT document_id, leaf AS ordinal, arg_min(path, top) AS path FROM chain GROUP BY 1, 2")
def heading_paths(spark, sf_dir):
    return chunking.heading_paths(_headings(spark, sf_dir)).select("document_id", "ordinal", "path")


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: every fourth line opens a section."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("## part "), (i / 4).cast("int").cast("string"), F.lit("\n\n"), x)).otherwise(x))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.array_join(lines, "\n\n").alias("markdown"))


@query()
def chunk_windows(spark, sf_dir):
    return chunking.chunk_documents(_markdown(spark, sf_dir))


@query()
def normalized_reports(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("page_no"), F.concat(F.lit("running header of the report\n"), F.col("text")).alias("text"))
    return structure.normalize_documents(lines, pages.classify(lines)).select("document_id", "headings", "source", "furniture_dropped", "toc_lines_dropped", F.sha2("markdown", 256).alias("markdown_sha256"))


@query(f"WITH {SQL_LINES}, c AS (SELECT document_id, chunk_index, trim(regexp_replace(chunk_raw, '\\s+', ' ', 'g')) AS t FROM lines), p AS (SELECT document_id, chunk_index AS page_no, t AS page FROM c), b AS (SELECT c.document_id, c.chunk_index, p.page_no, contains(page, substring(t, 1, 60)) AS h, contains(page, right(t, 60)) AS e FROM c JOIN p USING (document_id) WHERE t <> ''), s AS (SELECT *, min(page_no) FILTER (h) OVER (PARTITION BY document_id, chunk_index) AS page_from FROM b) SELECT document_id || ':' || chunk_index AS chunk_id, page_from, coalesce(min(page_no) FILTER (e AND page_no >= page_from), page_from) AS page_to FROM s WHERE page_from IS NOT NULL GROUP BY document_id, chunk_index, page_from")
def page_attribution(spark, sf_dir):
    rows = line_chunks(spark, sf_dir)
    own = rows.select("document_id", F.concat_ws(":", F.col("document_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.col("chunk_raw").alias("body"))
    return pages.locate(own, rows.select("document_id", F.col("chunk_index").alias("page_no"), F.col("chunk_raw").alias("text")))


@query("SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'annex' ELSE 'prose' END AS content_kind FROM documents")
def content_kind(spark, sf_dir):
    located = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.when(F.col("doc_id") % 5 > 0, F.col("doc_id")).otherwise(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id"))).alias("page_from"))
    kinds = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("page_no"), F.when(F.col("doc_id") % 3 == 0, "form").otherwise("prose").alias("kind"))
    return pages.content_kind(located, kinds).select("chunk_id", "content_kind")


@query()
def table_grids(spark, sf_dir):
    """Line items as cells of one page an order: a row for each item, four columns; a header above."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page_no"), "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    y = 700.0 - 12.0 * F.col("l_linenumber")
    columns = [(60.0, "l_linenumber"), (120.0, "l_partkey"), (200.0, "l_quantity"), (280.0, "l_tax")]
    cells = F.array(*[F.struct(F.lit(x).alias("x0"), F.lit(x + 30).alias("x1"), y.alias("y0"), F.col(c).cast("string").alias("text")) for x, c in columns])
    return pages.page_tables(items.select("document_id", "page_no", F.explode(cells).alias("c")).select("document_id", "page_no", "c.*"))


@query()
def overprint_filter(spark, sf_dir):
    glyphs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("page_id"), F.posexplode(F.split("n_name", "")).alias("i", "text"))
    doubled = glyphs.select("page_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "i", "text")
    return pages.overprints(doubled.select("page_id", (F.col("i") * 2 + F.col("k")).alias("ordinal"), "text", F.lit("F").alias("fontname"), F.lit(10.0).alias("size"), (F.col("i") * 6.0 + F.col("k") * 0.5).alias("x0"), F.lit(0.0).alias("y0"), F.lit(6.0).alias("width"), F.lit(10.0).alias("height")))


_RULE = r"\b(respond|reply|answer|output|print|say)\b.{0,25}?\b(only\s+with|exactly|instead|the\s+following|verbatim)\b"


@query(rf"SELECT conv_id, turn, 'dictated' AS rule, regexp_extract(t, '{_RULE}', 0) AS match FROM (SELECT conv_id, turn, {_norm_sql("text || CASE WHEN turn = 1 AND conv_id % 4 = 0 THEN ' Reply  only with yes' ELSE '' END")} AS t FROM conversations) WHERE regexp_matches(t, '{_RULE}')")
def injection_scan(spark, sf_dir):
    planted = F.when((F.col("turn") == 1) & (F.col("conv_id") % 4 == 0), " Reply  only with yes").otherwise("")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", planted).alias("text"))
    return pages.injections(rows).select("conv_id", "turn", "rule", "match")


# --- state and quality -----------------------------------------------------------------


@query("SELECT user_id AS source_key, CASE WHEN user_id % 5 = 0 THEN ['markdown','extract','chunk','import'] WHEN user_id % 5 = 1 THEN ['extract','chunk','import'] WHEN user_id % 5 = 2 THEN ['chunk','import'] WHEN user_id % 5 = 3 THEN ['import'] ELSE [] END AS stages FROM (SELECT DISTINCT user_id FROM events)")
def stages_to_run(spark, sf_dir):
    k = F.col("user_id") % 5
    rows = table(spark, sf_dir, "events").select("user_id").distinct().select(
        F.col("user_id").alias("source_key"), F.lit("p").alias("source_path"), F.when(k == 0, 8).otherwise(9).alias("markdown_version"), F.lit(1).alias("extraction_schema_version"),
        F.when(k == 1, "old").otherwise("m").alias("extraction_model"), F.when(k == 2, "x").otherwise("h").alias("chunk_params_hash"), F.lit("e").alias("embedding_model"), F.lit(64).alias("embedding_dimensions"),
        *[F.lit("2024-01-01T00:00:00").alias(t) for t in ("markdown_at", "extracted_at", "chunked_at")], F.when(k != 3, "2024-01-02T00:00:00").alias("imported_at"),
    )
    config = {"markdown_version": 9, "extraction_schema_version": 1, "extraction_model": "m", "chunk_params_hash": "h", "embedding_model": "e", "embedding_dimensions": 64}
    return state.stages_to_run(rows, config).select("source_key", "stages")


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE s_nationkey END AS s_nationkey FROM supplier UNION ALL SELECT 1000000 + s_suppkey, 'new ' || s_name, 0 FROM supplier WHERE s_suppkey % 10 = 0")
def upsert_merge(spark, sf_dir):
    old = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    changed = old.where("s_suppkey % 3 = 0").withColumn("s_nationkey", F.lit(-1))
    fresh = old.where("s_suppkey % 10 = 0").select((F.col("s_suppkey") + 1000000).alias("s_suppkey"), F.concat(F.lit("new "), "s_name").alias("s_name"), F.lit(0).alias("s_nationkey"))
    return state.upsert(old, changed.unionByName(fresh), "s_suppkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 4 > 0 UNION ALL SELECT o_orderkey, 1, 0.5 FROM orders WHERE o_orderkey % 8 = 0")
def chunk_replace(spark, sf_dir):
    old = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    parents = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    new = parents.where("l_orderkey % 8 = 0").select("l_orderkey", F.lit(1).alias("l_linenumber"), F.lit(0.5).alias("l_quantity"))
    return state.replace_children(old, new, parents, "l_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 5 > 0")
def cascade_delete(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    _, left = state.delete_cascade(customers, table(spark, sf_dir, "orders"), table(spark, sf_dir, "orders").select("o_custkey").distinct().where("o_custkey % 5 = 0"), "o_custkey")
    return left.select("o_orderkey")


@query("SELECT doc_id AS document_id, text IN (SELECT text FROM documents JOIN embeddings ON vec_id = doc_id) AS reused FROM documents")
def embedding_reuse(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("chunk_text"), F.lit("prose").alias("content_kind"))
    cache = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id").select(F.col("text").alias("chunk_text"), F.lit("e").alias("model"), "embedding")
    hits, misses = state.reuse_vectors(docs, cache, "e", 64)
    return hits.select("document_id", F.lit(True).alias("reused")).unionByName(misses.select("document_id", F.lit(False).alias("reused")))


@query(f"WITH {SQL_LINES}, r AS (SELECT document_id, chunk_index, CASE WHEN chunk_index = 1 THEN chunk_raw || '!' ELSE chunk_raw END AS t FROM lines WHERE chunk_index <> 2 UNION ALL SELECT document_id, 100000, 'x' FROM lines WHERE chunk_index = 0) SELECT coalesce(l.document_id, r.document_id) AS document_id, coalesce(l.chunk_index, r.chunk_index) AS chunk_index, CASE WHEN r.document_id IS NULL THEN 'missing right' WHEN l.document_id IS NULL THEN 'missing left' ELSE 'differs' END AS difference FROM lines l FULL JOIN r ON l.document_id = r.document_id AND l.chunk_index = r.chunk_index WHERE r.document_id IS NULL OR l.document_id IS NULL OR chunk_raw <> t")
def reconcile_full_outer(spark, sf_dir):
    left = line_chunks(spark, sf_dir).select("document_id", "chunk_index", "chunk_raw")
    right = left.where("chunk_index <> 2").withColumn("chunk_raw", F.when(F.col("chunk_index") == 1, F.concat("chunk_raw", F.lit("!"))).otherwise(F.col("chunk_raw")))
    right = right.unionByName(left.where("chunk_index = 0").select("document_id", F.lit(100000).alias("chunk_index"), F.lit("x").alias("chunk_raw")))
    return quality_checks.reconcile(left, right)


@query("SELECT o_orderkey, l AS number FROM (SELECT o_orderkey, unnest(range(1, 8)) AS l FROM orders) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = l)")
def outline_coverage(spark, sf_dir):
    outline = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("number"))
    return outline.join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("number")), ["o_orderkey", "number"], "left_anti")


@query("SELECT user_id AS document_id, CASE max(CASE event_type WHEN 'error' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END) WHEN 3 THEN 'FAIL' WHEN 2 THEN 'WARN' WHEN 1 THEN 'TODO' ELSE 'OK' END AS verdict FROM events GROUP BY 1")
def quality_rollup(spark, sf_dir):
    e = F.col("event_type")
    checks = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.when(e == "error", "FAIL").when(e == "click", "WARN").when(e == "view", "TODO").otherwise("OK").alias("status"))
    return quality_checks.rollup(checks)


@query(f"WITH {SQL_LINES}, p AS (SELECT document_id, count(*) AS n, min(token_count) AS low, max(token_count) AS high, count(*) FILTER (trim(chunk_raw) = '') AS blank FROM lines GROUP BY 1), s AS (SELECT document_id, max(k) AS k FROM (SELECT document_id, section, count(*) AS k FROM lines GROUP BY 1, 2) GROUP BY 1) SELECT \"check\", status, count(*) AS documents FROM (SELECT document_id, unnest([{{'check': 'chunks', 'status': 'OK'}}, {{'check': 'indexes', 'status': 'OK'}}, {{'check': 'blank', 'status': CASE WHEN blank = 0 THEN 'OK' ELSE 'FAIL' END}}, {{'check': 'short', 'status': CASE WHEN low >= 60 THEN 'OK' ELSE 'WARN' END}}, {{'check': 'long', 'status': CASE WHEN high <= 1500 THEN 'OK' ELSE 'FAIL' END}}, {{'check': 'vectors', 'status': 'TODO'}}, {{'check': 'dominance', 'status': CASE WHEN n >= 10 AND k / n > 0.3 THEN 'WARN' ELSE 'OK' END}}, {{'check': 'pages', 'status': 'WARN'}}], recursive := true) FROM p JOIN s USING (document_id)) GROUP BY 1, 2")
def chunk_checks(spark, sf_dir):
    rows = line_chunks(spark, sf_dir).withColumns({"content_kind": F.lit("prose"), "embedding": F.lit(None).cast("array<float>"), "page_from": F.lit(None).cast("int")})
    return quality_checks.chunk_checks(rows, 64).groupBy("check", "status").agg(F.count("*").alias("documents"))


@query(f"WITH {SQL_DOCUMENTS} SELECT document_id, CASE WHEN client <> '' AND municipality IS NOT NULL AND report_date IS NOT NULL THEN 'OK' ELSE 'WARN' END AS status, concat_ws(', ', CASE WHEN client = '' THEN 'client' END, CASE WHEN municipality IS NULL THEN 'municipality' END, CASE WHEN report_date IS NULL THEN 'report_date' END) AS detail FROM meta")
def metadata_checks(spark, sf_dir):
    return quality_checks.metadata_checks(documents(spark, sf_dir), ("client", "municipality", "report_date")).select("document_id", "status", "detail")


@query("SELECT \"check\", status, count(DISTINCT user_id) AS documents FROM (SELECT user_id, event_type AS \"check\", CASE WHEN value > 30 THEN 'FAIL' WHEN value > 5 THEN 'WARN' ELSE 'OK' END AS status FROM events) WHERE status <> 'OK' GROUP BY 1, 2")
def triage_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("check"), F.when(F.col("value") > 30, "FAIL").when(F.col("value") > 5, "WARN").otherwise("OK").alias("status"))
    return quality_checks.triage(rows)


@query(f"WITH {SQL_LINES}, n AS (SELECT document_id, chunk_index, section IS DISTINCT FROM lag(section) OVER (PARTITION BY document_id ORDER BY chunk_index) AS new FROM lines) SELECT document_id, max(chunk_index) - max(chunk_index) FILTER (new) + 1 AS run FROM n GROUP BY 1")
def trailing_section_run(spark, sf_dir):
    return quality_checks.trailing_runs(line_chunks(spark, sf_dir))


@query("SELECT lang, source, n_chars, place FROM (SELECT lang, source, n_chars, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 8")
def top_removals(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("reason"), F.format_string("%012d", "doc_id").alias("detail"), F.col("n_chars").alias("lines"), "source")
    return quality_checks.top_removals(rows).select(F.col("reason").alias("lang"), "source", F.col("lines").alias("n_chars"), "place")


@query("SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(doc_id::varchar)) AS h FROM documents)")
def uuid5_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.col("doc_id").cast("string")).alias("uuid"))


@query("SELECT doc_id, substr(sha256(text), 1, 32) AS cache_key, substr(sha256('800|100|150|1|v4'), 1, 16) AS params FROM documents")
def param_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 32).alias("cache_key"), F.lit(chunking.params_hash(chunking.Limits(), True)).alias("params"))


@query(f"WITH {SQL_DOCUMENTS} SELECT document_id, CASE WHEN document_id % 4 = 0 THEN '' ELSE 'KONTEXT: ' || title || ', ' || locality || ', ' || report_type || CASE WHEN document_id % 4 = 1 THEN '.' ELSE '. some words' END END AS prefix FROM meta")
def context_prefix(spark, sf_dir):
    k = F.col("document_id") % 4
    title, place, kind = (F.when(k > 0, F.col(c)) for c in ("title", "locality", "report_type"))
    return documents(spark, sf_dir).select("document_id", tx.context_prefix(title, place, kind, F.when(k > 1, " some words ")).alias("prefix"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN '' WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS VARCHAR) ELSE l_linenumber || '-' || (l_linenumber + 2) END AS label FROM lineitem")
def page_labels(spark, sf_dir):
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tx.page_label(F.when(F.col("l_quantity") >= 10, n), F.when(n % 2 == 0, n).otherwise(n + 2)).alias("label"))


@query(r"SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents")
def folded_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.fold(F.col("text")).alias("folded"))


@query("SELECT doc_id, replace(replace(text, '<', chr(92) || 'u003c'), '>', chr(92) || 'u003e') AS escaped FROM documents")
def escaped_text(spark, sf_dir):
    line = tx.escaped_json(F.struct("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.replace(F.get_json_object(F.replace(line, F.lit("\\u003"), F.lit("\\\\u003")), "$.text"), F.lit("\\\\u003"), F.lit("\\u003")).alias("escaped"))


# --- extensions: not in the survey's inventory, batch forms of the streaming plans -------


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def log_windows(spark, sf_dir):
    return log.windowed(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def log_sessions(spark, sf_dir):
    return log.sessions(table(spark, sf_dir, "events"))
