"""File sources and sinks: discovery, pages, Markdown, JSON lines, golden questions, results."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUFFIXES = (".pdf", ".md", ".markdown")
STEM = r"(?i)\.(pdf|md|markdown)$"
LOG_SCHEMA = "asked_at timestamp, source string, question string, status string, model string, prompt_version int, cache string, server_ms double, client_ms double"
EVIDENCE = T.StructType([T.StructField("doc", T.StringType()), T.StructField("contains", T.ArrayType(T.StringType()))])
GOLDEN = T.StructType([T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("question", T.StringType()), T.StructField("evidence", T.ArrayType(EVIDENCE))])
QUESTION_TYPES = ("morphology", "exact", "paraphrase", "multi", "annex", "negative")


def discover(spark: SparkSession, folders: list[str]) -> DataFrame:
    """path, name, stem, suffix, length, modified of source files, by folder as given and then by name; folders aren't searched in depth."""
    out = None
    for k, folder in enumerate(folders):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).drop("content")
        out = files.withColumn("folder", F.lit(k)) if out is None else out.unionByName(files.withColumn("folder", F.lit(k)))
    name = F.element_at(F.split("path", "/"), -1)
    out = out.select("path", name.alias("name"), "length", F.col("modificationTime").alias("modified"), "folder")
    out = out.withColumn("suffix", F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))).where(F.col("suffix").isin(*SUFFIXES))
    return out.withColumn("stem", stem(F.col("name"))).orderBy("folder", "name")


def stem(name):
    """A name without a known suffix; other dots stay."""
    return F.regexp_replace(name, STEM, "")


def only(sources: DataFrame, wanted: list[str]) -> DataFrame:
    """The sources named by path, file name or stem; a name that matches none is an error."""
    found = sources.where(F.col("path").isin(*wanted) | F.col("name").isin(*wanted) | F.col("stem").isin(*wanted))
    seen = {x for r in found.select("path", "name", "stem").limit(10 * len(wanted)).collect() for x in r}
    if missing := [w for w in wanted if w not in seen]:
        raise FileNotFoundError(f"no source named {missing}")
    return found


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """document_id (the stem) and markdown of whole files."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.{md,markdown}").select("value", F.col("_metadata.file_name").alias("name"))
    return rows.select(stem(F.col("name")).alias("document_id"), F.col("value").alias("markdown"))


def read_page_maps(spark: SparkSession, path: str, suffix: str = ".pages.json") -> DataFrame:
    """document_id, page_no, value of files that hold a JSON list of strings, by position."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter=f"*{suffix}").select("value", F.col("_metadata.file_name").alias("name"))
    pages = rows.select(F.substring_index("name", suffix, 1).alias("document_id"), F.posexplode(F.from_json("value", "array<string>")).alias("at", "value"))
    return pages.select("document_id", (F.col("at") + 1).alias("page_no"), "value")


def pdf_pages(paths: DataFrame) -> DataFrame:
    """path, page_no, text of PDF files. Needs a PDF library on the executors; without one, bring extracted pages."""
    try:
        import pdfminer.high_level  # noqa: F401
    except ImportError as e:
        raise NotImplementedError("no PDF library here: read page maps with read_page_maps()") from e

    def work(batches):
        import io

        import pandas as pd
        from pdfminer.high_level import extract_text
        from pdfminer.pdfpage import PDFPage

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                n = sum(1 for _ in PDFPage.get_pages(io.BytesIO(content)))
                yield pd.DataFrame([(path, i + 1, extract_text(io.BytesIO(content), page_numbers=[i])) for i in range(n)], columns=["path", "page_no", "text"])

    return paths.select("path", "content").mapInPandas(work, "path string, page_no int, text string")


def missing_pages(sources: DataFrame, cache: DataFrame) -> DataFrame:
    """Sources whose pages are not cached, or cached as blank throughout."""
    usable = cache.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("document_id").distinct()
    return sources.join(usable, "document_id", "left_anti")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """Question log lines; lines that aren't JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def validate_golden(questions: list[dict]) -> list[str]:
    """All problems of a golden set."""
    problems, seen = [], set()
    for k, q in enumerate(questions):
        name = q.get("id") or f"#{k + 1}"
        if not q.get("id") or name in seen:
            problems.append(f"{name}: missing or repeated id")
        seen.add(name)
        if q.get("type") not in QUESTION_TYPES:
            problems.append(f"{name}: unknown type {q.get('type')!r}")
        if not str(q.get("question") or "").strip():
            problems.append(f"{name}: no question")
        evidence = q.get("evidence") or []
        if (q.get("type") == "negative") != (not evidence):
            problems.append(f"{name}: negative questions, and only they, have no evidence")
        problems += [f"{name}: evidence without document or snippets" for e in evidence if not e.get("doc") or not any(str(s).strip() for s in e.get("contains") or [])]
    return problems


def load_golden(spark: SparkSession, text: str) -> DataFrame:
    """Questions of a golden set in JSON, or in YAML if a YAML library is there; raises with all problems."""
    try:
        questions = json.loads(text)
    except json.JSONDecodeError:
        import yaml

        questions = yaml.safe_load(text)
    questions = questions["questions"] if isinstance(questions, dict) else questions
    if problems := validate_golden(questions):
        raise ValueError("\n".join(problems))
    rows = [(q["id"], q["type"], q["question"], [(e["doc"], list(e["contains"])) for e in q.get("evidence") or []]) for q in questions]
    return spark.createDataFrame(rows, GOLDEN)


def select_questions(questions: DataFrame, ids: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    if ids:
        known = {r["id"] for r in questions.where(F.col("id").isin(*ids)).select("id").collect()}
        if missing := [i for i in ids if i not in known]:
            raise KeyError(f"unknown questions {missing}")
        questions = questions.where(F.col("id").isin(*ids))
    return questions.where(F.col("type").isin(*kinds)) if kinds else questions


def write_results(result: DataFrame, path: str) -> None:
    result.write.mode("overwrite").json(path)


def safe_name(name: str, suffix: str = ".pdf") -> str:
    """A plain file name of the given suffix, or an error."""
    p = PurePosixPath(name)
    if name != p.name or "\\" in name or name in ("", ".", "..") or p.suffix.lower() != suffix:
        raise ValueError(f"not a plain {suffix} name: {name!r}")
    return name
