import brute
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from evidspark.llm import pii, quality  # noqa: E402


def test_stages(spark, data):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "encoding"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    bench = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    stage = dict(corpus_pipeline.STAGES)

    def rows(df):
        assert df.columns == columns
        return {r.doc_id: r.text for r in df.collect()}

    verdict = {r.doc_id: r for r in quality.judge(docs).collect()}
    one = rows(a := stage["quality_rules"](spark, docs, data).cache())
    assert one == {i: v.clean_text for i, v in verdict.items() if v.kept}
    two = rows(b := stage["near_duplicates"](spark, a, data).cache())
    assert 0 < len(two) < len(one) and all(one[i] == t for i, t in two.items())
    three = rows(c := stage["decontamination"](spark, b, data).cache())
    dirty = {d for d, w in brute.decontaminate(list(two.items()), bench).items() if w[-1]}
    assert set(three) == set(two) - dirty
    four = rows(d := stage["personal_data"](spark, c, data))
    assert four == {i: pii.redact(t, pii.find_spans(t)) for i, t in three.items()}
    assert all(brute.pii(t)[0] == 0 for t in four.values())
    last = stage["encoding"](spark, d, data)
    assert set(r.doc_id for r in last.collect()) == set(four)


def test_stages_take_odd_rows(spark, data):
    """Nulls, repeats, an id with two texts, clashing columns and an empty table."""
    long = [" ".join(f"{c}word{i % 7}x{i}" for i in range(60)) + "." for c in "abc"]
    rows = [(1, long[0]), (1, long[0]), (1, long[1]), (2, long[1]), (3, long[0]), (None, long[2]), (None, long[2]), (4, None), (5, ""), (None, None), (6, long[2] + " me@x.org")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.selectExpr("*", *[f"1 AS {c}" for c in ("row", "id", "mark", "cls", "_gone", "words", "found", "kept", "n_words", "spans")])
    for start, want in ((docs, {(1, 0), (1, 1), (None, 2), (6, 2)}), (docs.limit(0), set())):
        now = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, data).cache()
            assert now.columns == start.columns, name
        assert {(r.doc_id, "abc".index(r.text[0])) for r in now.collect()} == want
        last = corpus_pipeline.STAGES[-1][1](spark, now, data)
        assert last.count() == now.count() and {"doc_id", "ids"} <= set(last.columns)


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert {"doc_id", "ids"} <= set(out.columns) and out.count() > 0
