"""Registered queries without SQL against plain loops: every row of the table takes part."""

import json

import pytest

from evidspark.plans.document_queries import QUERIES


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """(folder, documents): ids with gaps, past the first blocks of ids, of 1 to 45 lines."""
    folder = str(tmp_path_factory.mktemp("small"))
    docs = [(i, "\n".join(f"line {k} of {i} " + "word " * ((i * 7 + k * 5) % 60) for k in range(1 + i * 11 % 45)), "en", f"src{i % 3}") for i in [*range(0, 95), *range(103, 131, 2), 1000, 1001]]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return folder, docs


def test_grading_prompts(spark, small):
    folder, docs = small
    blocks = {}
    for i, text, _, source in sorted(docs):
        blocks.setdefault(i // 40, []).append((source, text))
    want = {}
    for q, rows in blocks.items():
        for k, (source, text) in enumerate(rows):
            want.setdefault((q, k // 20), []).append({"id": k + 1, "section": source, "text": text})
    rows = QUERIES["grading_prompts"](spark, folder).collect()
    assert len(rows) == len(want)
    for r in rows:
        *lines, last = r.prompt.split("\n")
        assert [json.loads(x) for x in lines] == want[r.question_id, r.batch] and last == "what is <this>?"


def candidates(spark, docs):
    """question: its lines as (place by hash, chunk_id, document, index, text), from all lines of all documents."""
    lines = [(f"{i}:{k}", i, k, line) for i, text, _, _ in docs for k, line in enumerate(text.split("\n"))]
    hashes = {r.chunk_id: r.h for r in spark.createDataFrame([(x[0],) for x in lines], "chunk_id string").selectExpr("chunk_id", "xxhash64(chunk_id) AS h").collect()}
    out = {}
    for c, i, k, line in lines:
        out.setdefault(i // 8, []).append((hashes[c], c, i, k, line))
    return {q: sorted(rows) for q, rows in out.items()}


def packed(rows):
    """(chunk_id, document, index, cost) in the order of choice: grade 2 or more, three of a document first, 8 sources, 10,000 tokens."""
    fit, chosen = [(c, i, k, max(1, len(line) // 3) * 10) for _, c, i, k, line in rows if k % 4 >= 2], []
    for most in (3, 10**9):
        for x in fit:
            if x not in chosen and len(chosen) < 8 and sum(y[3] for y in chosen) + x[3] <= 10_000 and sum(y[1] == x[1] for y in chosen) < most:
                chosen.append(x)
    return chosen


def test_context_budget_pack(spark, small):
    folder, docs = small
    want = {(q, c, i, cost, p) for q, rows in candidates(spark, docs).items() for p, (c, i, _, cost) in enumerate(packed(rows), 1)}
    got = [(r.question_id, r.chunk_id, r.document_id, r.cost, r.position) for r in QUERIES["context_budget_pack"](spark, folder).collect()]
    assert len(got) == len(want) and set(got) == want
    assert any(int(c.split(":")[1]) >= 12 for _, c, *_ in want)


def test_context_neighbours(spark, small):
    folder, docs = small
    want = set()
    for q, rows in candidates(spark, docs).items():
        chosen, text = packed(rows), {(i, k): line for _, _, i, k, line in rows}
        taken, spent = {(i, k) for _, i, k, _ in chosen}, sum(x[3] for x in chosen)
        want |= {(q, c, "nalezeno") for c, *_ in chosen}
        near, n = {}, 0
        for p, (_, i, k, _) in enumerate(chosen):
            for x in (k - 1, k + 1):
                if (i, x) in text and (i, x) not in taken and x // 4 == k // 4:
                    near.setdefault((i, x), (p, x))
        for i, x in sorted(near, key=near.get):
            cost = max(1, len(text[i, x]) // 3)
            if n < 4 and spent + cost <= 10_000:
                n, spent = n + 1, spent + cost
                want.add((q, f"{i}:{x}", "kontext"))
    out = QUERIES["context_neighbours"](spark, folder).collect()
    assert len(out) == len(want) and {(r.question_id, r.chunk_id, r.role) for r in out} == want
