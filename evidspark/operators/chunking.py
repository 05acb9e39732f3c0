"""Section-aware chunks of Markdown documents, one document at a time inside a grouped Arrow function."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evidspark.functions.text import uuid5
from evidspark.runtime import ship

CHUNKER_VERSION = 4
#: Characters of chunks that are given back at once, and what a chunk counts besides its text.
AT_ONCE, ROW = 2_000_000, 100
CHUNK_NAMESPACE = "2d4a7f61-0000-5000-8000-000000000000"
_HEADING = re.compile(r"(#{1,6})\s+(.*\S)\s*")


class Tokenizer(Protocol):
    def split(self, text: str) -> list[str]:
        """Pieces that join to the text."""


class WordTokenizer:
    """Deterministic default: a word, a punctuation mark or a run of white space before them."""

    _pattern = re.compile(r"\s*(?:\w{1,6}|[^\w\s]|\s+$)")

    def split(self, text: str) -> list[str]:
        return self._pattern.findall(text)


class BpeTokenizer:
    """A tiktoken rank file as the counter; the path is a parameter."""

    def __init__(self, path: str, pattern: str):
        import base64

        import tiktoken

        with open(path) as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
        self._encoding = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def split(self, text: str) -> list[str]:
        return [self._encoding.decode([i]) for i in self._encoding.encode_ordinary(text)]


@dataclass(frozen=True)
class Limits:
    max_tokens: int = 800
    overlap: int = 100
    min_tokens: int = 150

    def __post_init__(self) -> None:
        if self.overlap >= self.max_tokens:
            raise ValueError("overlap must be smaller than max_tokens")


class Chunker:
    def __init__(self, limits: Limits = Limits(), tokenizer: Tokenizer | None = None):
        self.limits, self.tokenizer = limits, tokenizer or WordTokenizer()

    def count(self, text: str) -> int:
        return len(self.tokenizer.split(text))

    def sections(self, markdown: str) -> list[tuple[str | None, str]]:
        """(heading path, body) of every section with a body."""
        path: dict[int, str] = {}
        out: list[tuple[str | None, list[str]]] = [(None, [])]
        for line in markdown.splitlines():
            if m := _HEADING.fullmatch(line):
                level = len(m[1])
                path = {k: v for k, v in path.items() if k < level} | {level: m[2].strip()}
                out.append((" > ".join(path[k] for k in sorted(path)), []))
            else:
                out[-1][1].append(line)
        return [(name, body) for name, lines in out if (body := "\n".join(lines).strip())]

    def cut(self, text: str, most: int) -> Iterator[str]:
        """A text without paragraph borders, on the token grid."""
        tokens, step = self.tokenizer.split(text), max(1, most - self.limits.overlap)
        at = 0
        while True:
            if piece := "".join(tokens[at : at + most]).strip():
                yield piece
            if at + most >= len(tokens):
                return
            at += step

    def windows(self, body: str, most: int) -> Iterator[str]:
        """Runs of whole paragraphs within the limit, the last of them repeated as overlap."""
        held: list[tuple[str, int]] = []

        def close() -> Iterator[str]:
            text = "\n\n".join(p for p, _ in held)
            if text:
                yield from [text] if self.count(text) <= most else self.cut(text, most)

        for paragraph in filter(None, (p.strip() for p in re.split(r"\n\s*\n", body))):
            n = self.count(paragraph)
            if n > most:
                yield from close()
                held = []
                yield from self.cut(paragraph, most)
                continue
            if held and sum(c for _, c in held) + n + len(held) > most:
                yield from close()
                held = self.overlap_of(held)
            held.append((paragraph, n))
        yield from close()

    def overlap_of(self, held: list[tuple[str, int]]) -> list[tuple[str, int]]:
        room, keep = self.limits.overlap, 0
        while keep < len(held) and held[-1 - keep][1] <= room:
            room -= held[-1 - keep][1]
            keep += 1
        if keep:
            return held[-keep:]
        tail = "".join(self.tokenizer.split(held[-1][0])[-self.limits.overlap :]).strip() if self.limits.overlap else ""
        return [(tail, self.count(tail))] if tail else []

    def chunks(self, markdown: str) -> list[dict]:
        """chunk_index, section, chunk_raw, body, token_count in document order."""
        pieces: list[list] = []
        for section, body in self.sections(markdown or ""):
            title = f"{section.rsplit(' > ', 1)[-1]}\n\n" if section else ""
            whole = self.count(title + body) <= self.limits.max_tokens
            parts = [body] if whole else self.windows(body, max(1, self.limits.max_tokens - self.count(title)))
            for part in parts:
                text, n = title + part, self.count(title + part)
                last = pieces[-1] if pieces and pieces[-1][0] == section else None
                if last and min(last[2], n) < self.limits.min_tokens and last[2] + n <= self.limits.max_tokens:
                    last[1] += "\n\n" + text
                    last[2] = self.count(last[1])
                else:
                    pieces.append([section, text, n, title])
        return [{"chunk_index": i, "section": s, "chunk_raw": t, "body": t.removeprefix(title), "token_count": n} for i, (s, t, n, title) in enumerate(pieces)]


def chunk_batches(batches: Iterator[pa.RecordBatch], chunker: Chunker, fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Chunks of (document_id, markdown), a document at a time, in batches of about AT_ONCE characters."""
    rows, held = [], 0
    for batch in batches:
        for d, m in zip(batch.column(0), batch.column(1), strict=True):
            for c in chunker.chunks(m.as_py()):
                rows.append({"document_id": d.as_py(), **c})
                held += len(c["chunk_raw"]) + len(c["body"]) + ROW
                if held >= AT_ONCE:
                    yield pa.RecordBatch.from_pylist(rows, fields)
                    rows, held = [], 0
    yield pa.RecordBatch.from_pylist(rows, fields)


def chunk_documents(documents: DataFrame, limits: Limits = Limits(), tokenizer: Tokenizer | None = None) -> DataFrame:
    """documents (document_id, markdown) to chunks with chunk_id; documents are independent, so nothing is shuffled."""
    ship(documents.sparkSession)
    chunker = Chunker(limits, tokenizer)

    kind = documents.schema["document_id"].dataType
    schema = T.StructType([T.StructField("document_id", kind), *T.StructType.fromDDL("chunk_index int, section string, chunk_raw string, body string, token_count int")])
    fields = to_arrow_schema(schema)
    out = documents.select("document_id", "markdown").mapInArrow(lambda batches: chunk_batches(batches, chunker, fields), schema)
    return out.withColumn("chunk_id", uuid5(CHUNK_NAMESPACE, F.concat_ws(":", F.col("document_id").cast("string"), F.col("chunk_index").cast("string"))))


def heading_paths(headings: DataFrame) -> DataFrame:
    """headings (document_id, ordinal, level 1..6, title) plus path: natively, the last title of each level since a smaller one."""
    order = Window.partitionBy("document_id").orderBy("ordinal")
    rows = headings
    for k in range(1, 7):
        # Place of the last heading of level k, and of the last one of a smaller level.
        rows = rows.withColumn(f"_t{k}", F.max(F.when(F.col("level") == k, F.struct("ordinal", "title"))).over(order)).withColumn(f"_s{k}", F.max(F.when(F.col("level") < k, F.col("ordinal"))).over(order))
    parts = [F.when((F.col("level") >= k) & (F.col(f"_t{k}.ordinal") > F.coalesce(f"_s{k}", F.lit(-1))), F.col(f"_t{k}.title")) for k in range(1, 7)]
    return rows.withColumn("path", F.concat_ws(" > ", *parts)).drop(*[f"_{x}{k}" for x in "ts" for k in range(1, 7)])


def params_hash(limits: Limits, context: bool, version: int = CHUNKER_VERSION) -> str:
    import hashlib

    return hashlib.sha256(f"{limits.max_tokens}|{limits.overlap}|{limits.min_tokens}|{int(context)}|v{version}".encode()).hexdigest()[:16]
