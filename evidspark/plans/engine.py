"""The engine: search, compare, answer and catalog calls over a documents and a chunks frame."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidspark.functions.text import snippet
from evidspark.operators import branches, catalog, citations, context, fusion, grading
from evidspark.operators.filters import Filters, parse_query
from evidspark.operators.index import query_words

MODES = ("fts", "fts_any", "vector", "hybrid", "hybrid_any", "rerank")
STEPS = ("start", "cache", "retrieval", "gate", "context", "generation", "validation")
PROMPT_VERSION = 2


class Unavailable(RuntimeError):
    """A provider did not answer."""


class Embedder(Protocol):
    model: str | None
    dimensions: int

    def embed(self, text: str) -> Sequence[float]: ...


class Answerer(Protocol):
    """Statements of (text, source_ids, quotes) and a status, from a question and a rendered context."""

    model: str | None

    def answer(self, question: str, prompt: str, sources: list[dict]) -> dict: ...


class HashEmbedder:
    """Deterministic default: signed hashes of words. No language model, and says so."""

    model = None

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, text: str) -> Sequence[float]:
        out = [0.0] * self.dimensions
        for w in text.lower().split():
            h = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")
            out[h % self.dimensions] += 1.0 if h >> 63 else -1.0
        n = sum(x * x for x in out) ** 0.5
        return [x / n for x in out] if n else out


class ExtractiveAnswerer:
    """Quotes the first sentence of each of the best sources."""

    model = None

    def answer(self, question: str, prompt: str, sources: list[dict]) -> dict:
        statements = []
        for s in sources[:2]:
            quote = (s["chunk_raw"] or "").split(". ")[0].strip()[:200]
            if quote:
                statements.append({"text": quote, "source_ids": [s["id"]], "quotes": [quote]})
        return {"status": "answered" if statements else "insufficient", "statements": statements, "missing": [], "conflicts": []}


@dataclass
class Answer:
    status: str
    statements: list[dict]
    sources: list[dict]
    trace: dict = field(default_factory=dict)


class Engine:
    """documents: document_id and metadata; chunks: chunk_id, document_id, chunk_index, section, content_kind, page_from, page_to, chunk_raw, token_count, embedding."""

    def __init__(self, documents: DataFrame, chunks: DataFrame, embedder: Embedder | None = None, grader: grading.Grader | None = None, answerer: Answerer | None = None, stop_words: Iterable[str] = (), fingerprint: str = ""):
        self.documents, self.chunks = documents, chunks
        self.embedder, self.grader, self.answerer = embedder or HashEmbedder(), grader or grading.LexicalGrader(), answerer or ExtractiveAnswerer()
        self.stop_words, self.fingerprint = tuple(stop_words), fingerprint
        self.query_embedding = lru_cache(256)(lambda text: tuple(self.embedder.embed(text)))
        self.answers: dict[str, Answer] = {}

    def _allowed(self, filters: Filters) -> DataFrame | None:
        on_documents = [k for k in filters.as_dict() if k != "content_kind"]
        if not on_documents:
            return None
        names = {c: F.col(c) for c in self.documents.columns}
        return self.documents.where(filters.predicate(names, "documents")).select("document_id")

    def compare(self, query: str, modes: Sequence[str] = MODES, limit: int = 10, filters: Filters = Filters(), candidates: int = fusion.CANDIDATES) -> dict[str, DataFrame]:
        """Ranked hits by mode; each branch is planned once for all modes."""
        text, inline = parse_query(query, ids_are_uuids=False)
        if len(query) > 1000 or not 1 <= limit <= 50:
            raise ValueError("queries have at most 1000 characters and limits lie between 1 and 50")
        if not text or (unknown := set(modes) - set(MODES)):
            raise ValueError("a search needs words" if not text else f"unknown modes {unknown}")
        filters = inline.merge(filters)
        fused = bool({"hybrid", "hybrid_any", "rerank"} & set(modes))
        fetch = fusion.fetch_size(limit, fused, "rerank" in modes, candidates)
        chunks = self.chunks.where(F.coalesce("content_kind", F.lit("prose")) == filters.content_kind) if filters.content_kind else self.chunks
        allowed = self._allowed(filters)
        order = (F.desc("score"), "document_id", "chunk_index", "chunk_id")
        vector = fusion.ranked(branches.vector(chunks, self.query_embedding(text), fetch, allowed), "vector")
        strict = fusion.ranked(branches.fts(chunks, text, fetch, self.stop_words, allowed), "fts", *order)
        loose = fusion.ranked(branches.fts_any(chunks, text, fetch, self.stop_words, allowed), "fts", F.desc("score"), F.desc("rank"), *order[1:])
        out = {}
        for mode in modes:
            if mode in ("fts", "fts_any"):
                own = strict if mode == "fts" else loose
                hits = fusion.annotate(own.where(F.col("fts_rank") <= limit), vector).withColumn("rank", F.col("fts_rank"))
            elif mode == "vector":
                hits = fusion.annotate(vector.where(F.col("vector_rank") <= limit), loose).withColumn("rank", F.col("vector_rank"))
            else:
                both = fusion.fuse(vector, strict if mode == "hybrid" else loose)
                if mode == "rerank":
                    hits = self.rerank(text, fusion.select_candidates(both, candidates)).where(F.col("rerank_rank") <= limit).withColumn("rank", F.col("rerank_rank"))
                else:
                    hits = both.where(F.col("fused_rank") <= limit).withColumn("rank", F.col("fused_rank"))
            out[mode] = self.hydrate(hits, text)
        return out

    def search(self, query: str, mode: str = "hybrid_any", limit: int = 10, filters: Filters = Filters()) -> DataFrame:
        return self.compare(query, (mode,), limit, filters)[mode]

    def rerank(self, question: str, candidates: DataFrame) -> DataFrame:
        texts = candidates.select("chunk_id", "candidate_rank").join(self.chunks, "chunk_id")
        grades = self.grader.grade(question, texts).withColumn("ordinal", F.lit(0))
        if isinstance(self.grader, grading.NoGrader):
            graded = candidates.withColumns({"rerank_grade": F.lit(None).cast("int"), "rerank_reason": F.lit(None).cast("string")})
        else:
            graded = grading.align(candidates, grades)
        return grading.order_by_grade(graded)

    def hydrate(self, hits: DataFrame, text: str) -> DataFrame:
        """Document and chunk columns, snippet, headline and lexical match of the survivors only."""
        wide = catalog.hydrate(hits, self.chunks.drop("embedding"), self.documents)
        flagged = branches.lexical_match(wide, self.chunks.select("chunk_id", "chunk_raw"), text, self.stop_words)
        return flagged.withColumns({"snippet": snippet(F.col("chunk_raw")), "headline": F.when(F.col("lexical_match"), catalog.headline(F.col("chunk_raw"), query_words(text)))}).orderBy("rank")

    def neighbours(self, document_id, index: int, before: int = 1, after: int = 1) -> DataFrame:
        return catalog.window_around(self.chunks, document_id, index, before, after)

    def facets(self, names: tuple[str, ...] = catalog.FACETS) -> DataFrame:
        return catalog.facets(self.documents, names)

    def list_documents(self, filters: Filters = Filters()) -> DataFrame:
        names = {c: F.col(c) for c in self.documents.columns}
        return catalog.list_documents(self.documents.where(filters.predicate(names, "documents")), self.chunks)

    def cache_key(self, question: str, filters: Filters, options: dict) -> str:
        """Everything that an answer depends on, the grader's model and the corpus included."""
        parts = {"question": " ".join(question.lower().split()), "filters": filters.as_dict(), "options": options, "model": self.answerer.model, "grader": self.grader.model, "prompt": PROMPT_VERSION, "corpus": self.fingerprint}
        return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]

    def answer(self, question: str, filters: Filters = Filters(), candidates: int = fusion.CANDIDATES, min_grade: int = grading.MIN_GRADE, on_progress: Callable[[str], None] = lambda step: None) -> Answer:
        """Retrieve, grade, gate, pack, answer, check. A closed gate never asks the model. At most `candidates` rows come to the driver."""
        began = time.monotonic()
        on_progress("start")
        key = self.cache_key(question, filters, {"candidates": candidates, "min_grade": min_grade})
        on_progress("cache")
        if key in self.answers:
            old = self.answers[key]
            return Answer(old.status, old.statements, old.sources, old.trace | {"cache": "hit", "usage": {}})
        on_progress("retrieval")
        hits = self.compare(question, ("rerank",), min(candidates, 50), filters, candidates)["rerank"].cache()
        try:
            on_progress("gate")
            open_ = hits.where(grading.passes_gate(F.col("rerank_grade"), min_grade))
            if open_.isEmpty():
                sources = [r.asDict() | {"role": "pod prahem"} for r in hits.limit(5).collect()]
                return self._keep(key, Answer("no_evidence", [], sources, {"gate": {"passed": 0}}), began)
            on_progress("context")
            rows = hits.withColumns({"question_id": F.lit("q"), "cost": context.token_cost(F.col("token_count"), F.col("chunk_raw"))})
            chosen = context.pack(rows, min_grade).join(hits.select("chunk_id", "chunk_index", "section", "rerank_grade"), "chunk_id")
            placed = context.add_neighbours(chosen, self.chunks)
            numbered = context.number_sources(placed)
            header = ["title", "municipality", "report_type", "report_date", "organization"]
            meta = self.documents.select("document_id", *[F.col(c) if c in self.documents.columns else F.lit(None).cast("string").alias(c) for c in header])
            body = self.chunks.select("chunk_id", *[F.col(c) if c in self.chunks.columns else F.lit(None).cast("string").alias(c) for c in ("content_kind", "page_from", "page_to", "chunk_raw")])
            full = numbered.join(body, "chunk_id").join(meta, "document_id")
            prompt = context.render(full).first()["prompt"]
            sources = [r.asDict() for r in full.orderBy("id").collect()]  # at most 12
        finally:
            hits.unpersist()
        on_progress("generation")
        given = self.answerer.answer(question, prompt, sources)
        on_progress("validation")
        spark = self.chunks.sparkSession
        statements = spark.createDataFrame([("a", i, s["text"], s["source_ids"], s["quotes"]) for i, s in enumerate(given["statements"])], "answer_id string, statement_id int, text string, source_ids array<int>, quotes array<string>")
        known = spark.createDataFrame([("a", s["id"], s["chunk_raw"], *[None if s[c] is None else str(s[c]) for c in citations.HEADER]) for s in sources], "answer_id string, id int, chunk_raw string, " + ", ".join(f"{c} string" for c in citations.HEADER))
        checked = [r.asDict() for r in citations.check(statements, known).orderBy("statement_id").collect()]
        verified = sum(c["check"] == "verified" for c in checked)
        status = given["status"]
        if not checked:
            status = "insufficient" if status == "answered" else status
        elif verified < len(checked):
            status = "partial" if verified else "insufficient"
        cited = {i for c in checked for i in c["source_ids"] or []}
        sources = [s | {"cited": s["id"] in cited} for s in sources]
        return self._keep(key, Answer(status, checked, sources, {"validation": {"verified": verified, "statements": len(checked)}, "model": self.answerer.model}), began)

    def _keep(self, key: str, answer: Answer, began: float) -> Answer:
        answer.trace |= {"cache": "miss", "total_ms": round((time.monotonic() - began) * 1000, 1)}
        self.answers[key] = answer
        return answer

    def log_record(self, question: str, answer: Answer) -> dict:
        """What the question log keeps: no prompt and no raw answer."""
        return {"question": question, "status": answer.status, "model": self.answerer.model, "prompt_version": PROMPT_VERSION, "cache": answer.trace.get("cache"), "server_ms": answer.trace.get("total_ms"), "statements": [{k: s[k] for k in ("text", "check", "source_ids", "quotes")} for s in answer.statements]}
