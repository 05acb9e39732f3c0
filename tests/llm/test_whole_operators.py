"""Cases of the training-data operators that an earlier round did not cover."""

import random
import tracemalloc

import brute
import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from evidspark.llm import arrowtext, decontaminate, licenses, near_dedup, pii
from evidspark.llm.oracles import DECONTAMINATE


def test_near_dedup_short_permuted(spark):
    texts = ["foo bar", "bar foo", "a b c", "c b a", "b a c", "Foo bar", "a", "a a", "a b c d", "d c b a", "x y z w", "a b c"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.digest(near_dedup.link(docs, size=4)).collect()}
    assert out == brute.near_dups(rows)
    kept = {r.doc_id for r in near_dedup.keep_one(docs, size=5).collect()}
    assert kept == {i for i, t in rows if t.lower() not in {x.lower() for x in texts[:i]}}


def found(text, kind):
    return [text[a:b] for a, b in pii.find_spans(text)[kind]]


def test_pii_cues():
    for cue in ("Account Number: ", "Account No ", "ACCOUNT no. ", "Social Security Number: ", "Acct. No. ", "SSN ", "sSn number ", "account no: ", "\u0130 Kontonummer #"):
        text = f"My {cue}123-45-6789, thanks"
        assert found(text, "account") == ["123-45-6789"], cue
        assert pii.redact(text, pii.find_spans(text)) == f"My {cue}[ACCOUNT], thanks"
    assert found("Account Nobody 123456789, account number 12", "account") == []
    assert found("\u0130\u0130 Iban CZ65 0800 0000 1920 0014 5399.", "iban") == ["CZ65 0800 0000 1920 0014 5399"]


def test_pii_schemes():
    text = "See HTTPS://ex.org/a_(b)?q=1, (http://user:pw@h.cz/x). \u0130 <ftp://f.cz/> mailto:a%40b.cz; Tel:777-123-456 http://a.cz/?u=http://b.cz"
    assert found(text, "url") == ["HTTPS://ex.org/a_(b)?q=1", "http://user:pw@h.cz/x", "ftp://f.cz/", "mailto:a%40b.cz", "Tel:777-123-456", "http://a.cz/?u=http://b.cz"]
    assert pii.redact("call tel:777123456 or http://x.cz.", pii.find_spans("call tel:777123456 or http://x.cz.")) == "call [URL] or [URL]."
    assert found("hotel:777123456 xhttp://a.cz http:// tel:12 mailto:nobody http://...", "url") == []
    mixed = "mailto:a@b.cz http://1.2.3.4/ tel:+420777123456"
    assert brute.pii(mixed)[:4] == tuple(len(pii.find_spans(mixed)[k]) for k in pii.BASE) == (1, 1, 0, 1)


def test_decontaminate_items_without_id(spark):
    texts = ["start one two three four five six seven eight nine ten end", "alpha beta", "alpha gamma one two three four five six seven eight nine ten", None, "clean text"]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = [(None, "one two three four five six seven eight nine ten"), (7, "gamma"), (None, "Alpha beta"), (8, "start one"), (None, None)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    con = duckdb.connect()
    for name, df in (("documents", documents), ("benchmark", benchmark)):
        con.register(name, df.toArrow())
    columns = con.sql(DECONTAMINATE).columns
    for size in (decontaminate.BLOCK_BYTES, 60):
        out = decontaminate.digest(decontaminate.find_contamination(documents, benchmark, block_bytes=size)).select(*columns).collect()
        assert sorted(map(tuple, out)) == sorted(con.sql(DECONTAMINATE).fetchall())
        assert {r.doc_id for r in decontaminate.remove_contaminated(documents, benchmark, block_bytes=size).collect()} == {3, 4}
    assert {r.doc_id: r.n_items for r in out} == {0: 2, 1: 1, 2: 2, 3: 0, 4: 0}


def test_license_pairs_of_long_paragraphs(spark):
    n = (1 << 20) + 5
    texts = [(0, "x " * n + "Last Pair"), (1, "One two three"), (2, "one"), (3, ""), (4, None)]
    grams = spark.createDataFrame(texts, "id int, text string").select("id", licenses.grams_of(F.col("text")).alias("g"))
    out = {r.id: r for r in grams.select("id", F.size("g").alias("n"), F.array_contains("g", "last pair").alias("last"), F.slice("g", 1, 9).alias("g")).collect()}
    assert out[0].last and out[0].n == 2 * (n + 2) - 1
    assert out[1].g == ["one", "two", "three", "one two", "two three"] and out[2].g == ["one"] and out[3].g == []


def peak_mb(slices):
    """MB that numpy and Python take at most while slices are made one after another, and how many documents there were."""
    tracemalloc.start()
    n = sum(size(x) for x, size in slices)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak, n


def test_worker_memory_of_a_batch():
    """A batch of 8 MB is worked on in small slices, with the same results whatever their size."""
    rng = random.Random(3)
    column = pa.array([" ".join(f"w{rng.randrange(5000)}" for _ in range(500)) for _ in range(2600)])
    assert column.nbytes > 7e6
    arrowtext._powers.clear()
    peak, n = peak_mb((x, lambda x: len(x[1])) for x in near_dedup.shingle_sets(column, 5))
    assert n == len(column) and peak < 30
    arrowtext._powers.clear()
    bench = decontaminate.Benchmark(["a"], [column[7].as_py()], 10)
    peak, n = peak_mb((x, lambda x: len(x[1])) for x in decontaminate.hits(column, bench))
    assert n == len(column) and peak < 100

    few = column.slice(0, 40)
    whole = [x for _, sets in near_dedup.shingle_sets(few, 5) for x in sets]
    told = [x[1:] for x in decontaminate.hits(few, bench)]
    for at_most in (1, 9000):
        near, shard = near_dedup.SLICE_BYTES, decontaminate.SHARD_BYTES
        near_dedup.SLICE_BYTES = decontaminate.SHARD_BYTES = at_most
        try:
            again = [x for _, sets in near_dedup.shingle_sets(few, 5) for x in sets]
            cut = [x[1:] for x in decontaminate.hits(few, bench)]
        finally:
            near_dedup.SLICE_BYTES, decontaminate.SHARD_BYTES = near, shard
        assert all(map(np.array_equal, whole, again)) and len(whole) == len(again)
        assert len(cut) > 1 and [[y for x in cut for y in x[k]] for k in range(4)] == [list(x) for x in told[0]]


def test_worker_gives_memory_back():
    """What a task has freed goes back to the system when it ends; long texts leave no tables behind."""

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    def work(batches):
        for batch in batches:
            held = [np.ones(5000) for _ in range(8000)]  # 320 MB in pieces that lie side by side
            pins.append(np.ones(5000))  # and one behind them that stays
            del held
            yield batch

    pins = []
    before = resident()
    assert sum(b.num_rows for b in arrowtext.lean(work)(iter([pa.record_batch({"x": [1, 2]})]))) == 2
    assert resident() < before + 100
    arrowtext._powers.clear()
    long = pa.array(["word " * 500_000])
    assert len(near_dedup.shingle_sets(long, 5).__next__()[1][0]) == 1
    assert sum(x.nbytes for x in arrowtext._powers.values()) <= 2 * 8 * arrowtext.MOST_POWERS


def test_redaction_of_many_rows(spark):
    """More rows than are redacted at a time, in their order, with nulls."""
    rows = [(i, None if i % 7 == 0 else f"write to me{i}@x.org, {'ž' * (i % 5)}", 0) for i in range(3 * pii.SLICE_ROWS + 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint").coalesce(1)
    out = [tuple(r) for r in pii.redact_documents(docs, count_col="n_chars").collect()]
    want = [(i, t and pii.redact(t, pii.find_spans(t))) for i, t, _ in rows]
    assert out == [(i, t, t and len(t)) for i, t in want]
