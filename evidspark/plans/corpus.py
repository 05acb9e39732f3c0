"""The engine's tables derived from the shared test tables, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words that the registered searches ask for.
QUERY = "insh thintion estion ated quee the"
STRICT = "estion ndon"
STOP = ("the", "of", "and", "is", "que")
QUERY_VECTOR = 250


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """One chunk a document."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("source").alias("section"), F.col("text").alias("chunk_raw"))
    if vectors:
        rows = rows.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left")
        rows = rows.withColumn("content_kind", F.when(F.col("embedding").isNull(), "annex").otherwise("prose"))
    return rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of a document from its id, language and source."""
    rows = table(spark, sf_dir, "documents")
    return rows.select(
        F.col("doc_id").alias("document_id"),
        F.concat(F.lit("report "), F.col("doc_id").cast("string")).alias("title"),
        F.col("lang").alias("report_type"),
        F.col("source").alias("organization"),
        F.concat(F.lit("author "), (F.col("doc_id") % 7).cast("string")).alias("author"),
        F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("client "), (F.col("doc_id") % 5).cast("string"))).otherwise("").alias("client"),
        F.concat(F.lit("place "), (F.col("doc_id") % 11).cast("string")).alias("locality"),
        F.when(F.col("doc_id") % 13 > 0, F.concat(F.lit("town "), (F.col("doc_id") % 13).cast("string"))).alias("municipality"),
        F.when(F.col("doc_id") % 17 > 0, F.date_add(F.lit("2015-01-01").cast("date"), (F.col("doc_id") % 3000).cast("int"))).alias("report_date"),
    )


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk a line: document_id, chunk_index, chunk_raw, section (every fourth line starts a new one), token_count."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "chunk_raw"))
    section = F.concat(F.lit("s"), F.floor(F.col("chunk_index") / 4).cast("string"))
    return rows.select("document_id", "chunk_index", "chunk_raw", section.alias("section"), F.greatest(F.lit(1), F.floor(F.length("chunk_raw") / 3)).cast("int").alias("token_count"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = QUERY_VECTOR) -> list[float]:
    """One stored vector as the query."""
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


#: DuckDB: every token of every document.
SQL_TOKENS = r"""tok AS (SELECT chunk_id, unnest(t) AS lexeme, unnest(range(len(t))) AS pos FROM
 (SELECT doc_id AS chunk_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS t FROM documents))"""
SQL_DOCUMENTS = """meta AS (SELECT doc_id AS document_id, 'report ' || doc_id AS title, lang AS report_type, source AS organization, 'author ' || doc_id % 7 AS author,
 CASE WHEN doc_id % 5 > 0 THEN 'client ' || doc_id % 5 ELSE '' END AS client, 'place ' || doc_id % 11 AS locality,
 CASE WHEN doc_id % 13 > 0 THEN 'town ' || doc_id % 13 END AS municipality,
 CASE WHEN doc_id % 17 > 0 THEN DATE '2015-01-01' + CAST(doc_id % 3000 AS INTEGER) END AS report_date FROM documents)"""
SQL_LINES = """lines AS (SELECT document_id, chunk_index, chunk_raw, 's' || (chunk_index // 4) AS section, greatest(1, length(chunk_raw) // 3) AS token_count FROM
 (SELECT doc_id AS document_id, unnest(range(len(l))) AS chunk_index, unnest(l) AS chunk_raw FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""
SQL_CHUNKS = """chunks AS (SELECT doc_id AS chunk_id, doc_id AS document_id, 0 AS chunk_index, source AS section, text AS chunk_raw, embedding,
 CASE WHEN embedding IS NULL THEN 'annex' ELSE 'prose' END AS content_kind FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"""
