"""Tables and pipeline state: bootstrap, upsert, chunk replacement, vector reuse, stages to run.

Parquet tables have no row updates, so a change writes a new version of the table, and a
small pointer file names the current one; readers never see a half-written version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES = ("markdown", "extract", "chunk", "import")
DOCUMENTS = """document_id string, source_file string, source_sha256 string, markdown_path string, title string, report_type string, locality string,
 report_date date, author string, client string, summary string, municipality string, organization string,
 extraction string, extraction_schema_version int, extraction_model string, created_at timestamp, updated_at timestamp"""
CHUNKS = """document_id string, chunk_id string, chunk_index int, section string, content_kind string, page_from int, page_to int,
 chunk_raw string, chunk_text string, token_count int, embedding array<float>"""


class VersionedTable:
    """A Parquet table of versions under one folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def version(self) -> str | None:
        fs, path = self._fs()
        pointer = path(f"{self.path}/CURRENT")
        return self.spark.read.text(f"{self.path}/CURRENT").first()[0] if fs.exists(pointer) else None

    def read(self) -> DataFrame:
        """The current version; columns that it lacks are null, so new columns need no rewrite."""
        current = self.version()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{current}") if current else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame) -> str:
        name = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        fs, path = self._fs()
        out = fs.create(path(f"{self.path}/CURRENT.next"), True)
        out.write(bytearray(name.encode()))
        out.close()
        self._swap(path(f"{self.path}/CURRENT.next"), path(f"{self.path}/CURRENT"))
        return name

    def _swap(self, new, old) -> None:
        """Rename over the old file in one step, so that a reader sees the one or the other."""
        jvm = self.spark._jvm
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(new, old, how)


def bootstrap(spark: SparkSession, root: str) -> dict[str, VersionedTable]:
    """The documents and chunks tables; may be called again."""
    return {"documents": VersionedTable(spark, f"{root}/documents", DOCUMENTS), "chunks": VersionedTable(spark, f"{root}/chunks", CHUNKS)}


def upsert(current: DataFrame, new: DataFrame, key: str = "source_file") -> DataFrame:
    """New rows replace current ones of the same key, all columns included."""
    return current.join(new.select(key), key, "left_anti").select(current.columns).unionByName(new, allowMissingColumns=True)


def replace_children(current: DataFrame, new: DataFrame, parents: DataFrame, key: str = "document_id") -> DataFrame:
    """All chunks of the given parents are replaced by the new ones, of which parents without any lose theirs."""
    return current.join(parents.select(key), key, "left_anti").select(current.columns).unionByName(new, allowMissingColumns=True)


def delete_cascade(documents: DataFrame, chunks: DataFrame, gone: DataFrame, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    return documents.join(gone.select(key), key, "left_anti"), chunks.join(gone.select(key), key, "left_anti")


def with_content_kind(chunks: DataFrame) -> DataFrame:
    """The added column with its default."""
    return chunks.withColumn("content_kind", F.coalesce("content_kind", F.lit("prose"))) if "content_kind" in chunks.columns else chunks.withColumn("content_kind", F.lit("prose"))


def reuse_vectors(chunks: DataFrame, cache: DataFrame, model: str, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """(chunks with a cached vector of the same text, model and size; the others). Annex chunks need none."""
    usable = cache.where((F.col("model") == model) & (F.size("embedding") == dimensions)).select(F.sha2("chunk_text", 256).alias("_key"), F.col("embedding").alias("_cached")).dropDuplicates(["_key"])
    keyed = chunks.withColumn("_key", F.sha2("chunk_text", 256))
    hits = keyed.join(usable, "_key").withColumn("embedding", F.col("_cached")).drop("_key", "_cached")
    misses = keyed.join(usable, "_key", "left_anti").drop("_key").where(F.coalesce("content_kind", F.lit("prose")) != "annex")
    return hits, misses


def stages_to_run(manifest: DataFrame, config: dict[str, object]) -> DataFrame:
    """manifest plus `stages`: from the first one that is stale, unfinished or whose output is missing, all that follow.

    manifest has markdown_version, extraction_schema_version, extraction_model, chunk_params_hash,
    embedding_model, embedding_dimensions, a time <stage>_at for each stage and optionally
    missing_output array<string>. A source without an entry (null source_path) runs everything.
    """

    def differs(*names: str):
        out = F.lit(False)
        for n in names:
            out = out | ~F.col(n).eqNullSafe(F.lit(config[n]))
        return out

    stale = F.when(differs("markdown_version"), 0).when(differs("extraction_schema_version", "extraction_model"), 1).when(differs("chunk_params_hash", "embedding_model", "embedding_dimensions"), 2).otherwise(9)
    times = ("markdown_at", "extracted_at", "chunked_at", "imported_at")
    undone = [F.when(F.col(t).isNull() | (F.col(t) == ""), k).otherwise(9) for k, t in enumerate(times)]
    lost = [F.when(F.array_contains(F.coalesce("missing_output", F.array().cast("array<string>")), s), k).otherwise(9) for k, s in enumerate(STAGES)] if "missing_output" in manifest.columns else []
    first = F.when(F.col("source_path").isNull(), 0).otherwise(F.least(stale, *undone, *lost))
    names = F.array(*[F.lit(s) for s in STAGES])
    return manifest.withColumn("stages", F.filter(names, lambda s, k: k >= first))


def needs_import(manifest: DataFrame) -> DataFrame:
    """Sources chunked after their last import; times are ISO texts and compare as such."""
    return manifest.where(F.col("chunked_at").isNotNull() & (F.col("imported_at").isNull() | (F.col("chunked_at") > F.col("imported_at"))))


def invalidate_downstream(manifest: DataFrame, changed: DataFrame, key: str = "source_key") -> DataFrame:
    """Sources whose Markdown changed (hash differs) lose the later stages' times."""
    hit = changed.select(key, F.lit(True).alias("_changed"))
    out = manifest.join(hit, key, "left")
    late = {t: F.when(F.coalesce("_changed", F.lit(False)), F.lit(None).cast("string")).otherwise(F.col(t)) for t in ("extracted_at", "chunked_at", "imported_at")}
    return out.withColumns(late).drop("_changed")


def run_plan(stages: dict[str, object], plan: list[str]) -> list[tuple[str, int]]:
    """Run the planned stages in order; (stage, failures). A stage with failures stops the next ones."""
    done = []
    for name in STAGES:
        if name in plan:
            failures = int(stages[name]() or 0)
            done.append((name, failures))
            if failures:
                break
    return done
