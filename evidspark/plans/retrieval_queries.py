"""Registered queries of retrieval, filters and catalog, each with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidspark.functions.text import collapse, snippet
from evidspark.operators import branches, catalog, fusion, index
from evidspark.operators.filters import Filters, date_bound
from evidspark.plans.corpus import QUERY, QUERY_VECTOR, SQL_CHUNKS, SQL_DOCUMENTS, SQL_LINES, SQL_TOKENS, STOP, STRICT, chunks, documents, line_chunks, query_vector, table

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
SQL: dict[str, str] = {}
FETCH = 40
_TERMS = "('insh'), ('thintion'), ('estion'), ('ated'), ('quee')"
_STOP = "('the', 'of', 'and', 'is', 'que')"
_ANY = f"""{SQL_TOKENS}, q(lexeme) AS (VALUES {_TERMS}), m AS (SELECT chunk_id, lexeme, count(*) AS tf FROM tok JOIN q USING (lexeme) GROUP BY ALL),
 df AS (SELECT lexeme, count(*) AS df FROM m GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
 s AS (SELECT chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5))), 6) AS score, round(sum(ln(1 + tf)), 6) AS rank FROM m JOIN df USING (lexeme), n GROUP BY 1),
 fa AS (SELECT chunk_id, chunk_id AS document_id, 0 AS chunk_index, score, rank FROM s ORDER BY score DESC, rank DESC, document_id, chunk_index, chunk_id LIMIT {FETCH})"""
_VEC = f"""qv AS (SELECT list_transform(embedding, lambda x: round(x::double, 6)) AS v FROM embeddings WHERE vec_id = {QUERY_VECTOR}),
 ve AS (SELECT vec_id AS chunk_id, round(list_cosine_similarity(embedding::double[], v), 6) AS score FROM embeddings JOIN documents ON doc_id = vec_id, qv ORDER BY score DESC, chunk_id LIMIT {FETCH})"""
_FUSED = f"""{_ANY}, {_VEC}, vr AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS vector_rank, score AS vector_score FROM ve),
 fr AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, rank DESC, document_id, chunk_index, chunk_id) AS fts_rank, score AS fts_score FROM fa),
 fu AS (SELECT chunk_id, vector_rank, vector_score, fts_rank, fts_score, coalesce(1.0::double / (60 + vector_rank), 0) + coalesce(1.0::double / (60 + fts_rank), 0) AS rrf_score FROM vr FULL JOIN fr USING (chunk_id)),
 fused AS (SELECT *, row_number() OVER (ORDER BY rrf_score DESC, vector_rank NULLS LAST, fts_rank NULLS LAST) AS fused_rank FROM fu)"""


def query(sql: str | None = None) -> Callable[[Q], Q]:
    def register(f: Q) -> Q:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _any(spark: SparkSession, sf_dir: str, fetch: int = FETCH) -> DataFrame:
    return branches.fts_any(chunks(spark, sf_dir), QUERY, fetch, STOP)


def _vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    rows = chunks(spark, sf_dir).select("chunk_id", "document_id", "chunk_index").join(vectors, "chunk_id")
    return branches.vector(rows, query_vector(spark, sf_dir), FETCH)


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    loose = fusion.ranked(_any(spark, sf_dir), "fts", F.desc("score"), F.desc("rank"), "document_id", "chunk_index", "chunk_id")
    return fusion.fuse(fusion.ranked(_vector(spark, sf_dir), "vector"), loose)


@query(f"WITH {_ANY} SELECT * FROM fa")
def fts_any_topk(spark, sf_dir):
    return _any(spark, sf_dir)


@query(f"WITH {SQL_TOKENS}, m AS (SELECT chunk_id, count(*) FILTER (lexeme = 'estion') AS a, count(*) FILTER (lexeme = 'ndon') AS b FROM tok WHERE lexeme IN ('estion', 'ndon') GROUP BY 1) SELECT chunk_id, chunk_id AS document_id, 0 AS chunk_index, round(ln(1 + a) + ln(1 + b), 6) AS score FROM m WHERE a > 0 AND b > 0 ORDER BY score DESC, chunk_id LIMIT {FETCH}")
def fts_all_terms(spark, sf_dir):
    return branches.fts(chunks(spark, sf_dir), STRICT, FETCH)


_PAIR = "SELECT DISTINCT a.chunk_id FROM tok a JOIN tok b ON a.chunk_id = b.chunk_id AND b.pos = a.pos + 1 WHERE a.lexeme = 'of' AND b.lexeme = 'the'"


@query(f"WITH {SQL_TOKENS}, p AS ({_PAIR}) SELECT chunk_id, round(ln(1 + count(*) FILTER (lexeme = 'of')) + ln(1 + count(*) FILTER (lexeme = 'the')), 6) AS score FROM tok JOIN p USING (chunk_id) GROUP BY 1")
def fts_phrase(spark, sf_dir):
    return index.match(index.chunk_tokens(chunks(spark, sf_dir)), index.parse_websearch('"of the"'))


@query(f"WITH {SQL_TOKENS} SELECT chunk_id, round(ln(1 + count(*) FILTER (lexeme = 'estion')), 6) AS score FROM tok GROUP BY 1 HAVING count(*) FILTER (lexeme = 'estion') > 0 AND count(*) FILTER (lexeme = 'ndon') = 0")
def fts_negation(spark, sf_dir):
    return index.match(index.chunk_tokens(chunks(spark, sf_dir)), index.parse_websearch("estion -ndon"))


@query(f"WITH {SQL_TOKENS} SELECT chunk_id, round(ln(1 + count(*) FILTER (lexeme = 'estion')) + ln(1 + count(*) FILTER (lexeme = 'quee')), 6) AS score FROM tok GROUP BY 1 HAVING count(*) FILTER (lexeme IN ('estion', 'quee')) > 0")
def fts_or(spark, sf_dir):
    return index.match(index.chunk_tokens(chunks(spark, sf_dir)), index.parse_websearch("estion or quee"))


@query(f"WITH {SQL_TOKENS} SELECT chunk_id, lexeme, count(*) AS tf, list_sort(list(pos))[1] AS first_pos FROM tok GROUP BY 1, 2")
def postings_build(spark, sf_dir):
    return index.chunk_postings(chunks(spark, sf_dir)).select("chunk_id", "lexeme", "tf", F.get("positions", F.lit(0)).alias("first_pos"))


@query(f"WITH {SQL_TOKENS}, d AS (SELECT lexeme, count(DISTINCT chunk_id) AS df FROM tok GROUP BY 1) SELECT lexeme, df, round(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)), 6) AS idf FROM d")
def lexeme_df_idf(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    total = rows.agg(F.count("*").alias("n"))
    df = index.document_frequency(index.chunk_tokens(rows)).crossJoin(F.broadcast(total))  # one row
    return df.select("lexeme", "df", F.round(index.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(f"WITH {SQL_TOKENS} SELECT lexeme, count(*) AS n FROM tok WHERE lexeme NOT IN {_STOP} GROUP BY 1")
def stopword_filtered_terms(spark, sf_dir):
    return index.stems(index.chunk_tokens(chunks(spark, sf_dir)), STOP).groupBy("lexeme").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_TOKENS}, lemmas(form, lemma) AS (VALUES ('insh', 'in'), ('ated', 'at'), ('ated', 'ate')) SELECT coalesce(lemma, lexeme) AS lexeme, count(*) AS n FROM tok LEFT JOIN lemmas ON form = lexeme GROUP BY 1")
def lemma_expansion(spark, sf_dir):
    lemmas = spark.createDataFrame([("insh", "in"), ("ated", "at"), ("ated", "ate")], "form string, lemma string")
    return index.stems(index.chunk_tokens(chunks(spark, sf_dir)), lemmas=F.broadcast(lemmas)).groupBy("lexeme").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES (1, 'insh'), (2, 'thintion'), (3, 'estion'), (4, 'ated'), (5, 'quee')) t(ordinal, word)")
def query_word_terms(spark, sf_dir):
    return spark.createDataFrame([(i + 1, t[0]) for i, t in enumerate(branches.terms(QUERY, STOP))], "ordinal int, word string")


@query(f"WITH {_VEC} SELECT chunk_id, chunk_id AS document_id, 0 AS chunk_index, score FROM ve")
def vector_topk(spark, sf_dir):
    return _vector(spark, sf_dir)


@query(f"WITH qv AS (SELECT list_transform(embedding, lambda x: round(x::double, 6)) AS v FROM embeddings WHERE vec_id = {QUERY_VECTOR}) SELECT vec_id AS chunk_id, vec_id AS document_id, 0 AS chunk_index, round(list_cosine_similarity(embedding::double[], v), 6) AS score FROM embeddings JOIN documents ON doc_id = vec_id, qv WHERE lang ILIKE '%e%' AND (source ILIKE '%src1%' OR source ILIKE '%src2%') ORDER BY score DESC, chunk_id LIMIT {FETCH}")
def vector_topk_filtered(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    rows = chunks(spark, sf_dir).select("chunk_id", "document_id", "chunk_index").join(vectors, "chunk_id")
    meta = documents(spark, sf_dir)
    wanted = Filters(report_type="e", organization=("src1", "src2")).predicate({c: F.col(c) for c in meta.columns}, "documents")
    return branches.vector(rows, query_vector(spark, sf_dir), FETCH, meta.where(wanted).select("document_id"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS length, round(u[1], 6) AS first FROM (SELECT vec_id, list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) AS u FROM embeddings)")
def unit_vectors(spark, sf_dir):
    from evidspark.functions.text import l2_normalize, norm

    rows = table(spark, sf_dir, "embeddings").select("vec_id", l2_normalize(F.col("embedding")).alias("u"))
    return rows.select("vec_id", F.round(norm(F.col("u")), 6).alias("length"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


@query(f"WITH {_FUSED} SELECT chunk_id, vector_rank, vector_score, fts_rank, fts_score, round(rrf_score, 6) AS rrf_score, fused_rank FROM fused WHERE fused_rank <= 20")
def hybrid_rrf(spark, sf_dir):
    return _fused(spark, sf_dir).where("fused_rank <= 20").withColumn("rrf_score", F.round("rrf_score", 6))


@query(f"WITH {_FUSED}, a AS (SELECT 'fts_any' AS mode, fts_rank AS rank, chunk_id FROM fr WHERE fts_rank <= 10 UNION ALL SELECT 'vector', vector_rank, chunk_id FROM vr WHERE vector_rank <= 10 UNION ALL SELECT 'hybrid_any', fused_rank, chunk_id FROM fused WHERE fused_rank <= 10) SELECT mode, rank, chunk_id, vector_rank, fts_rank FROM a LEFT JOIN vr USING (chunk_id) LEFT JOIN fr USING (chunk_id)")
def hybrid_any_compare(spark, sf_dir):
    loose = fusion.ranked(_any(spark, sf_dir), "fts", F.desc("score"), F.desc("rank"), "document_id", "chunk_index", "chunk_id")
    vector = fusion.ranked(_vector(spark, sf_dir), "vector")
    both = fusion.fuse(vector, loose)

    def mode(name, frame, rank):
        return frame.where(F.col(rank) <= 10).select(F.lit(name).alias("mode"), F.col(rank).alias("rank"), "chunk_id")

    views = mode("fts_any", loose, "fts_rank").unionByName(mode("vector", vector, "vector_rank")).unionByName(mode("hybrid_any", both, "fused_rank"))
    return fusion.annotate(fusion.annotate(views, vector.select("chunk_id", "vector_rank")), loose.select("chunk_id", "fts_rank"))


@query(f"WITH {_FUSED}, c AS (SELECT *, row_number() OVER (ORDER BY (coalesce(vector_rank <= 12, false) OR coalesce(fts_rank <= 12, false)) DESC, fused_rank) AS place FROM fused) SELECT chunk_id, vector_rank, fts_rank, fused_rank, row_number() OVER (ORDER BY fused_rank) AS candidate_rank FROM c WHERE place <= 24")
def candidate_selection(spark, sf_dir):
    return fusion.select_candidates(_fused(spark, sf_dir), 24).select("chunk_id", "vector_rank", "fts_rank", "fused_rank", "candidate_rank")


@query(f"WITH {_FUSED}, hits AS (SELECT chunk_id, fused_rank FROM fused WHERE fused_rank <= 30), w AS (SELECT DISTINCT chunk_id FROM tok WHERE lexeme IN ('insh', 'thintion', 'estion', 'ated', 'quee')) SELECT chunk_id, fused_rank, w.chunk_id IS NOT NULL AS lexical_match FROM hits LEFT JOIN w USING (chunk_id)")
def lexical_match_flag(spark, sf_dir):
    hits = _fused(spark, sf_dir).where("fused_rank <= 30").select("chunk_id", "fused_rank")
    return branches.lexical_match(hits, chunks(spark, sf_dir), QUERY, STOP)


@query(r"SELECT doc_id AS chunk_id, substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 300) AS snippet, CASE WHEN regexp_matches(lower(text), '(^|[^\p{L}\p{N}])estion($|[^\p{L}\p{N}])') THEN true END AS has_headline FROM documents")
def snippet_headline(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    return rows.select("chunk_id", snippet(F.col("chunk_raw")).alias("snippet"), F.when(catalog.headline(F.col("chunk_raw"), ["estion"]).isNotNull(), F.lit(True)).alias("has_headline"))


@query(f"WITH {_ANY} SELECT fa.chunk_id, score, title, report_type, organization, municipality FROM fa JOIN (WITH {SQL_DOCUMENTS} SELECT * FROM meta) m ON m.document_id = fa.document_id")
def hydrated_hits(spark, sf_dir):
    hits = _any(spark, sf_dir).select("chunk_id", "score")
    wide = catalog.hydrate(hits, chunks(spark, sf_dir).select("chunk_id", "document_id"), documents(spark, sf_dir))
    return wide.select("chunk_id", "score", "title", "report_type", "organization", "municipality")


@query(f"WITH {SQL_DOCUMENTS} SELECT * FROM meta WHERE (organization ILIKE '%SRC1%' OR organization ILIKE '%src_7%') AND author ILIKE '%AUTHOR 3%'")
def filter_ilike_any(spark, sf_dir):
    meta = documents(spark, sf_dir)
    return meta.where(Filters(organization=("SRC1", "src_7"), author="AUTHOR 3").predicate({c: F.col(c) for c in meta.columns}, "documents"))


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate <= DATE '1995-03-31'")
def filter_date_bounds(spark, sf_dir):
    spring = Filters(date_from=date_bound("1995", False), date_to=date_bound("1995-03", True))
    return table(spark, sf_dir, "orders").where(spring.predicate({"report_date": F.col("o_orderdate")})).select("o_orderkey", "o_orderdate", "o_totalprice")


@query(f"WITH {SQL_DOCUMENTS} SELECT document_id, title, report_date FROM meta WHERE document_id IN (3, 5, 8, 13, 9999999)")
def filter_in_ids(spark, sf_dir):
    meta = documents(spark, sf_dir)
    return meta.where(Filters(document_ids=("3", "5", "8", "13", "9999999")).predicate({c: F.col(c) for c in meta.columns}, "documents")).select("document_id", "title", "report_date")


@query(f"WITH {SQL_CHUNKS} SELECT chunk_id, content_kind FROM chunks WHERE content_kind = 'annex'")
def filter_content_kind(spark, sf_dir):
    rows = chunks(spark, sf_dir, vectors=True)
    return rows.where(Filters(content_kind="annex").predicate({"content_kind": F.col("content_kind")})).select("chunk_id", "content_kind")


@query("SELECT 'insh thintion' AS rest, 'src1' AS organization, DATE '2019-01-01' AS date_from, DATE '2019-09-30' AS date_to, 'annex' AS content_kind")
def parsed_query(spark, sf_dir):
    from evidspark.operators.filters import parse_query

    rest, f = parse_query("insh org:src1 od:2019 do:2019-09 druh:příloha thintion")
    return spark.createDataFrame([(rest, f.organization, f.date_from, f.date_to, f.content_kind)], "rest string, organization string, date_from date, date_to date, content_kind string")


@query(f"WITH {SQL_DOCUMENTS}, {SQL_CHUNKS} SELECT m.document_id, title, report_date, count(chunk_id) AS chunks, count(embedding) AS embedded FROM meta m LEFT JOIN chunks c ON c.document_id = m.document_id GROUP BY 1, 2, 3")
def list_documents_counts(spark, sf_dir):
    return catalog.list_documents(documents(spark, sf_dir).select("document_id", "title", "report_date"), chunks(spark, sf_dir, vectors=True))


@query(f"WITH {SQL_DOCUMENTS}, f AS (UNPIVOT (SELECT author, client, locality, municipality, report_type, organization FROM meta) ON COLUMNS(*) INTO NAME field VALUE value) SELECT field, value, count(*) AS n FROM f WHERE value <> '' GROUP BY 1, 2")
def facet_counts(spark, sf_dir):
    return catalog.facets(documents(spark, sf_dir))


@query(f"WITH {SQL_DOCUMENTS} SELECT min(year(report_date)) AS first_year, max(year(report_date)) AS last_year FROM meta")
def year_span(spark, sf_dir):
    return catalog.year_span(documents(spark, sf_dir))


@query(f"WITH {SQL_CHUNKS} SELECT content_kind, count(*) AS chunks, count(embedding) AS embedded FROM chunks GROUP BY 1")
def content_kind_split(spark, sf_dir):
    return catalog.content_kinds(chunks(spark, sf_dir, vectors=True))


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM documents JOIN embeddings ON vec_id = doc_id) AS embedded")
def corpus_counts(spark, sf_dir):
    return catalog.corpus_counts(documents(spark, sf_dir), chunks(spark, sf_dir, vectors=True))


@query("SELECT a.conv_id, a.turn, b.turn AS near_turn, b.role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN greatest(0, a.turn - 1) AND a.turn + 1 AND b.turn <> a.turn WHERE a.role = 'user'")
def neighbours_context(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    near = rows.select("conv_id", F.col("turn").alias("near_turn"), F.col("role").alias("near_role"))
    both = rows.where("role = 'user'").join(near, "conv_id").where(F.col("near_turn").between(F.greatest(F.lit(0), F.col("turn") - 1), F.col("turn") + 1) & (F.col("near_turn") != F.col("turn")))
    return both.select("conv_id", "turn", "near_turn", F.col("near_role").alias("role"))


@query(f"WITH {SQL_LINES} SELECT document_id, chunk_index, chunk_raw, chunk_index = 2 AS is_hit FROM lines WHERE document_id = 7 AND chunk_index BETWEEN 1 AND 4")
def document_window(spark, sf_dir):
    return catalog.window_around(line_chunks(spark, sf_dir), 7, 2, 1, 2).select("document_id", "chunk_index", "chunk_raw", "is_hit")


@query("SELECT event_id, CAST(props ->> '$.k' AS INTEGER) AS k FROM events")
def document_detail_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", catalog.json_field("props", "k", "int").alias("k"))


@query("SELECT lang, string_agg(source, ' | ' ORDER BY source) AS sources FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY 1")
def string_agg_terms(spark, sf_dir):
    return catalog.joined_values(table(spark, sf_dir, "documents"), ["lang"], "source", "sources")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def distinct_on_latest(spark, sf_dir):
    return catalog.latest_by(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT event_type, count(*) FILTER (value > 10) AS large, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def conditional_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*catalog.counts_where(large=F.col("value") > 10, n=F.lit(True)), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT event_id, sum(1) OVER () AS n FROM (SELECT event_id FROM events ORDER BY value DESC, event_id LIMIT 25)")
def top_values(spark, sf_dir):
    rows = table(spark, sf_dir, "events").orderBy(F.desc("value"), "event_id").limit(25)
    return rows.select("event_id", F.count("*").over(Window.partitionBy()).alias("n"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def collapsed_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", collapse(F.col("text")).alias("text"))
