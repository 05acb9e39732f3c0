"""Operators that must keep their cost or memory a row down on large tables, and their results against plain loops."""

import random
import time
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from evidspark.functions.text import collapse, snippet
from evidspark.operators import catalog, chunking, context, index, pages, structure


def test_many_pages_with_tables(spark):
    """100,000 pages in a batch, which a data frame for each would take minutes for; results as from single pages."""
    rng = random.Random(3)
    shapes = [[(60.0 + 80 * c + rng.choice([0, 0, 2, 5]), 700.0 - 12 * r, rng.choice(["a", "b", " ", None] if kind % 3 == 0 else ["a", "b"])) for r in range(kind % 7) for c in range(1 + kind % 5)] for kind in range(200)]
    cells = [sorted(s, key=lambda c: (c[0], c[1], c[2] or "")) for s in shapes]
    place = pa.struct([("x0", pa.float64()), ("y0", pa.float64()), ("text", pa.string())])
    one = pa.array([[{"x0": x, "y0": y, "text": t} for x, y, t in own] for own in cells], pa.list_(place))
    n = 500
    batch = pa.RecordBatch.from_arrays([pa.array(range(n * len(cells)), pa.int64()), pa.array([1] * (n * len(cells)), pa.int32()), pa.concat_arrays([one] * n)], ["document_id", "page_no", "cells"])
    began = time.process_time()
    lengths = batch.column(2).value_lengths().to_numpy()
    got = [r for a, b in pages._page_slices(lengths) for r in pages._tables(batch.slice(a, b - a)).to_pylist()]
    assert time.process_time() - began < 30
    want = {d: found for d, own in enumerate(cells) if (found := pages.grids(own))}
    assert len(want) > 20 and len(got) == n * len(want)
    for r in got:
        found = want[r["document_id"] % len(cells)]
        assert (r["columns"], r["rows"], r["grids"]) == (len(found[0][0]), sum(len(x) for _, x in found), len(found))
        assert r["header"] == next(([c[2] for c in x[0]] for k, x in found if len(x[0]) == len(k)), None)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_questions_share_batches(spark):
    """No Python call for each question, and chunks meet chosen ones by place, once; repeated sections and ids with gaps."""
    hits = spark.range(4000).selectExpr("id div 4 AS question_id", "id AS document_id", "concat(id, ':', 5) AS chunk_id", "5 AS chunk_index", "'s' AS section", "CAST(id % 4 AS int) AS rank", "CAST(3000 AS int) AS cost", "2 AS rerank_grade")
    chunks = spark.range(4000).selectExpr("id AS document_id", "explode(sequence(3, 7)) AS chunk_index").selectExpr("document_id", "chunk_index", "concat(document_id, ':', chunk_index) AS chunk_id", "IF(chunk_index = 6, 't', 's') AS section", "400 AS token_count", "'text' AS chunk_raw")
    chosen = context.pack(hits, carry=("chunk_index", "section", "rerank_grade"))
    out = context.add_neighbours(chosen, chunks)
    assert "FlatMapGroupsInPandas" not in plan_of(chosen) + plan_of(out) and plan_of(out).count("Window") == 0
    rows = out.collect()
    assert {(r.question_id, r.document_id, r.chunk_index, r.role) for r in rows} == {(q, 4 * q + k, 5, "nalezeno") for q in range(1000) for k in range(3)} | {(q, 4 * q + k, 4, "kontext") for q in range(1000) for k in range(2)}
    assert len(rows) == 5000


def test_postings_move_texts_alone(spark):
    """Tokens stay in the row of their chunk; rows of one id still meet, each counted from 0."""
    texts = [(1, "a b a c"), (1, "b Á"), (2, ""), (3, None), (4, "x"), (None, "a a"), (5, " ".join(f"w{i % 70}" for i in range(3000)))]
    chunks = spark.createDataFrame(texts, "chunk_id bigint, chunk_raw string")
    out, want = index.chunk_postings(chunks), index.postings(index.chunk_tokens(chunks))
    assert out.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect())) and out.count() == 5 + 70
    plan = plan_of(out)
    assert plan.index("Generate") < plan.index("Aggregate") and plan.count("Aggregate") == 1


def test_kinds_are_made_once(spark):
    rows = spark.createDataFrame([("d", i, t) for i, t in enumerate(["x", "", "se si " * 20, "y", "se si " * 20, "z", "q"])], "document_id string, page_no int, text string")
    out = pages.classify(rows)
    assert "Join" not in plan_of(out) and plan_of(out).count("regexp_extract_all") == 1
    assert {r.page_no: r.kind for r in out.collect()} == {0: "prose", 1: "empty"} | dict.fromkeys(range(2, 7), "form")


def test_snippets_and_headlines_of_long_texts(spark):
    """Snippets equal the start of the whole text without runs of white space; a headline is found in a long text without going over it many times."""
    texts = ["", " ", "  a  b ", "a\u00a0\n b" * 90, "x" * 299 + "  y", "x" * 299 + "  ", "\t" + "ab \n" * 120, "😀 " * 310, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select(snippet(F.col("t")).alias("got"), F.substring(collapse(F.col("t")), 1, 300).alias("want")).collect():
        assert r.got == r.want
    long = spark.createDataFrame([("abcdefghij" * 5 + " ") * 10_000 + "the Estion (b) here"], "string").toDF("t")
    began = time.perf_counter()
    [(found,)] = long.select(catalog.headline(F.col("t"), ["estion"])).collect()
    assert found.split(" ", 16)[-1].endswith("the <mark>Estion</mark> (b) here") and len(found.split()) == 20
    assert time.perf_counter() - began < 20


def test_chunks_leave_in_small_batches():
    """Many documents of one batch don't wait for each other."""
    markdown = "\n\n".join(["## part", *["some words of a line " * 30] * 20])
    batch = pa.RecordBatch.from_pydict({"document_id": list(range(1000)), "markdown": [markdown] * 1000})
    fields = pa.schema([("document_id", pa.int64()), ("chunk_index", pa.int32()), ("section", pa.string()), ("chunk_raw", pa.string()), ("body", pa.string()), ("token_count", pa.int32())])
    chunker = chunking.Chunker()
    n = len(chunker.chunks(markdown))
    sizes = [b.nbytes for b in chunking.chunk_batches(iter([batch]), chunker, fields)]
    assert max(sizes) < 3_000_000 and sum(sizes) > 20_000_000 and n > 1


def test_a_report_is_not_joined_in_memory():
    """One wide character made joined texts four times as large; lines keep their own width."""
    pages_ = ["\n".join(f"{p} {k} " + "some words of a line " * 15 for k in range(20)) for p in range(400)] + ["\U0001f600 end"]
    size = sum(map(len, pages_))
    tracemalloc.start()
    lines, _ = structure.normalized(pages_)
    out = structure.encoded(lines)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * size
    assert out[0].as_py() == "\n".join(lines) == structure.normalize(pages_)[0] == "\n".join(x.rstrip() if i == 8000 else x for i, x in enumerate("\n".join(pages_).splitlines())) + "\n"
