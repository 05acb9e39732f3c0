"""Removal of word windows that a smaller document already holds, with FM-indexes.

An index of everything, asked by every document, would grow with the square of the
corpus. So windows are dealt to shards by content: a window's anchor is the smallest
hash of its 4-word sequences, equal windows have equal anchors, and consecutive windows
with one anchor form a segment. All occurrences of a window are in the shard of its
anchor, and each document asks only the shards of its own segments.

1. Anchors are counted by document. One that a single document has is of no use.
2. Segments with a shared anchor travel to its shard as 48-bit word hashes. An anchor
   that more than `HOT` documents share is split further: its segments are cut into
   single windows, dealt by the hash of the whole window.
3. A task gathers shards up to a bounded size, keeps one copy of each equal segment (the
   others are covered by the copy with the smallest id), builds the FM-index and matches
   every segment backwards against smaller documents.
4. Matched intervals go back to their documents, which drop the covered words.

Intermediate tables are written to the shared folder. Nothing is collected.

Words are runs outside ASCII white space, unchanged. A null text has no words. A row
without an id is neither removed from nor compared with. Rows that repeat an id count
as one document, each with its own text. A text of fewer words than a window is never
touched. Extra columns are not read by the query and kept by the document form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidspark.llm import arrowtext as at
from evidspark.llm.fm_index import FMIndex
from evidspark.llm.store import release
from evidspark.runtime import forget, materialize, ship

WINDOW, GRAM = 13, 4
#: Documents that share an anchor, beyond which its segments are cut up.
HOT = 50_000
#: Words of one index, unless a single anchor has more.
INDEX_WORDS = 1 << 18


def segments(words: at.Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes of 48 bits, first word, number of windows, anchor) of a slice's segments."""
    h = words.hashes() >> np.uint64(16)
    k = len(h) - window + 1
    none = np.empty(0, np.int64)
    if k <= 0:
        return h, none, none, none
    low = (at.grams(h, GRAM) >> np.uint64(1)).astype(np.int64)
    span = window - GRAM + 1
    size = 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: k], low[span - size : span - size + k])
    left = words.left()[:k]
    owner = words.owner()[:k]
    inside = left >= window
    new = np.ones(k, bool)
    new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
    stop = np.concatenate([np.flatnonzero(new[1:] | (inside[:-1] & ~inside[1:])) + 1, [k]])
    first = np.flatnonzero(new & inside)
    length = stop[np.searchsorted(stop, first, "right")] - first
    return h, first, length, low[first]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, id), once for each document."""
    for batch in batches:
        ids = batch.column("id")
        for i, _, words in at.documents(batch.column("text"), at.WORDS):
            _, first, _, anchor = segments(words)
            if len(first):
                doc = np.searchsorted(words.at, first, "right") - 1
                order = np.lexsort((doc, anchor))
                a, d = anchor[order], doc[order]
                keep = np.ones(len(a), bool)
                keep[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), ids.take(pa.array(d[keep] + i))], names=["m", "id"])


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared segments with their words: (m, id, tid, start, body)."""
    for batch in batches:
        shared, hot = batch.column("shared"), batch.column("hot")
        for i, j, words in at.documents(batch.column("text"), at.WORDS):
            h, first, length, anchor = segments(words)
            wanted = np.unique(shared.slice(i, j - i).flatten().to_numpy(zero_copy_only=False))
            split = np.unique(hot.slice(i, j - i).flatten().to_numpy(zero_copy_only=False))
            keep = np.isin(anchor, wanted)
            first, length, anchor = first[keep], length[keep], anchor[keep]
            cut = np.isin(anchor, split)
            if cut.any():
                each = np.repeat(first[cut], length[cut]) + np.arange(length[cut].sum()) - np.repeat(np.cumsum(length[cut]) - length[cut], length[cut])
                whole = (at.grams(h, WINDOW)[each] >> np.uint64(1)).astype(np.int64)
                first, length, anchor = np.concatenate([first[~cut], each]), np.concatenate([length[~cut], np.ones(len(each), np.int64)]), np.concatenate([anchor[~cut], whole])
            if not len(first):
                continue
            n = length + WINDOW - 1
            ends = np.cumsum(n)
            pick = np.arange(ends[-1]) + np.repeat(first - (ends - n), n)
            body = np.ascontiguousarray(h[pick].view(np.uint8).reshape(-1, 8)[:, :6])
            doc = np.searchsorted(words.at, first, "right") - 1
            offsets = np.concatenate([[0], ends * 6]).astype(np.int32)
            bodies = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
            whose = pa.array(doc + i)
            out = pa.RecordBatch.from_arrays([pa.array(anchor), batch.column("id").take(whose), batch.column("tid").take(whose), pa.array((first - words.at[doc]).astype(np.int32)), bodies], names=["m", "id", "tid", "start", "body"])
            for k in range(0, out.num_rows, 20_000):
                yield out.slice(k, 20_000)


def _index(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Match the segments of some whole shards: (id, tid, start, end) of the words found in a smaller document."""
    rows = rows.combine_chunks()
    bodies = rows.column("body").chunk(0)
    offsets = np.frombuffer(bodies.buffers()[1], np.int32)[bodies.offset : bodies.offset + len(bodies) + 1].astype(np.int64)
    raw = np.frombuffer(bodies.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    h = wide.reshape(-1).view(np.uint64)
    first = (offsets[:-1] - offsets[0]) // 6
    n = np.diff(offsets) // 6
    ids = rows.column("id").to_numpy()
    # Equal segments: the first of each in order of id is the one that is matched.
    place = np.arange(len(h)) - np.repeat(first, n)
    mark = np.add.reduceat(at.mix(h * np.uint64(at._BASE) + at.mix(place.astype(np.uint64) + np.uint64(1))), first)
    order = np.lexsort((ids, mark))
    head = np.ones(len(order), bool)
    head[1:] = mark[order][1:] != mark[order][:-1]
    reps = order[head]
    rep_of = np.empty(len(order), np.int64)
    rep_of[order] = np.cumsum(head) - 1
    doc_names, doc = np.unique(ids[reps], return_inverse=True)
    rn, rf = n[reps], first[reps]
    ends = np.cumsum(rn)
    pick = np.arange(ends[-1]) + np.repeat(rf - (ends - rn), rn)
    _, symbol = np.unique(h[pick], return_inverse=True)
    index = FMIndex(symbol.astype(np.int64) + 1, rn, doc)
    hit = index.matched(doc, WINDOW)
    # Runs of matched window starts inside each matched segment.
    inside = np.zeros(len(hit) + 1, bool)
    inside[1:] = hit
    a = np.flatnonzero(hit & ~inside[:-1])
    b = np.flatnonzero(inside[1:] & ~np.concatenate([hit[1:], [False]])) + 1
    seg = np.searchsorted(index.first, a, "right") - 1
    runs_at = np.searchsorted(seg, np.arange(len(reps) + 1))
    smaller = ids > ids[reps][rep_of]  # an equal segment lies in a smaller document
    own = np.flatnonzero(~smaller)
    count = np.diff(runs_at)[rep_of[own]]
    row = np.repeat(own, count)
    run = np.repeat(runs_at[rep_of[own]], count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = rows.column("start").to_numpy().astype(np.int64)
    base = start[row] - index.first[seg[run]]
    whole = np.flatnonzero(smaller)
    row = np.concatenate([row, whole])
    lo = np.concatenate([a[run] + base, start[whole]]).astype(np.int32)
    hi = np.concatenate([b[run] + base + WINDOW - 1, start[whole] + n[whole]]).astype(np.int32)
    at_ = pa.array(row)
    yield pa.RecordBatch.from_arrays([rows.column("id").chunk(0).take(at_), rows.column("tid").chunk(0).take(at_), pa.array(lo), pa.array(hi)], names=["id", "tid", "lo", "hi"])


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by m; shards are taken together up to INDEX_WORDS words."""
    held: list[pa.RecordBatch] = []
    words = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        words += batch.column("body").get_total_buffer_size() // 6
        if words < INDEX_WORDS:
            continue
        table = pa.Table.from_batches(held)
        m = table.column("m").to_numpy()
        size = np.cumsum(pc.binary_length(table.column("body")).to_numpy().astype(np.int64) // 6)
        cuts = np.flatnonzero(m[1:] != m[:-1]) + 1  # a shard starts here
        begin = 0
        while len(cuts):
            before = size[begin - 1] if begin else 0
            k = np.searchsorted(size[cuts - 1], before + INDEX_WORDS, "right") - 1
            k = max(k, np.searchsorted(cuts, begin, "right"))
            if size[-1] - before < INDEX_WORDS or k >= len(cuts):
                break
            yield from _index(table.slice(begin, cuts[k] - begin))
            begin = int(cuts[k])
        rest = table.slice(begin).combine_chunks()
        held, words = rest.to_batches(), int(size[-1] - (size[begin - 1] if begin else 0))
    if held:
        yield from _index(pa.Table.from_batches(held))


def find_repeats(docs: DataFrame) -> DataFrame:
    """docs (id, text) to id, tid (hash of the text), spans: the word intervals to remove."""
    spark = docs.sparkSession
    ship(spark)
    named = docs.where("id is not null and text is not null")
    kind = docs.schema["id"].dataType.simpleString()
    pairs = named.mapInArrow(_pairs, f"m bigint, id {kind}")
    common = pairs.groupBy("m").agg(F.min("id").alias("x"), F.max("id").alias("y"), F.count("*").alias("n")).where("x != y").select("m", (F.col("n") > HOT).alias("hot"))
    lists = materialize(pairs.join(common, "m").groupBy("id").agg(F.collect_list("m").alias("shared"), F.collect_list(F.when(F.col("hot"), F.col("m"))).alias("hot")), "anchors")
    release(spark)
    sent = named.withColumn("tid", F.xxhash64("text")).join(lists, "id").mapInArrow(_send, f"m bigint, id {kind}, tid bigint, start int, body binary")
    found = sent.repartition("m").sortWithinPartitions("m").mapInArrow(_match, f"id {kind}, tid bigint, lo int, hi int")
    spans = materialize(found.groupBy("id", "tid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "repeats")
    forget(lists)
    release(spark)
    return spans


def _covered(batch: pa.RecordBatch, i: int, words: at.Words) -> np.ndarray:
    """Whether each word of the slice lies in one of its document's spans."""
    spans = batch.column("spans").slice(i, words.n_docs)
    sizes = np.array([0 if x is None else x for x in pc.list_value_length(spans).to_pylist()], np.int64)
    flat = spans.flatten()
    base = np.repeat(words.at[:-1], sizes)
    step = np.zeros(len(words.start) + 1, np.int32)
    np.add.at(step, base + flat.field("lo").to_numpy(zero_copy_only=False).astype(np.int64), 1)
    np.add.at(step, base + flat.field("hi").to_numpy(zero_copy_only=False).astype(np.int64), -1)
    return np.cumsum(step[:-1]) > 0


def kept_words(words: at.Words, gone: np.ndarray) -> list[bytes]:
    """Each document's remaining words, joined by one space."""
    keep = np.flatnonzero(~gone)
    doc = np.searchsorted(words.at, keep, "right") - 1
    out = words.raw.copy()
    step = np.zeros(len(out) + 1, np.int32)
    step[words.start[keep]] += 1
    np.add.at(step, words.end[keep], -1)
    mask = np.cumsum(step[:-1]) > 0
    more = words.end[keep[:-1][doc[1:] == doc[:-1]]]  # another word follows, so this byte is white space
    out[more] = 32
    mask[more] = True
    out = out[mask].tobytes()
    size = np.bincount(doc, (words.end - words.start)[keep], words.n_docs).astype(np.int64)
    n = np.bincount(doc, minlength=words.n_docs)
    ends = np.cumsum(size + np.maximum(n - 1, 0))
    return [out[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)]


def _joined(docs: DataFrame, spans: DataFrame) -> DataFrame:
    right = spans.select(F.col("id").alias("_id"), F.col("tid").alias("_tid"), "spans")
    docs = docs.withColumn("tid", F.xxhash64("text"))
    return docs.join(right, (F.col("id") == F.col("_id")) & (F.col("tid") == F.col("_tid")), "left").drop("_id", "_tid", "tid")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The op6 columns for every row."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in at.documents(batch.column("text"), at.WORDS):
                gone = _covered(batch, i, words)
                removed = np.add.reduceat(np.concatenate([gone, [False]]).astype(np.int64), words.at[:-1]) * (np.diff(words.at) > 0)
                digests = [hashlib.sha256(x).hexdigest() for x in kept_words(words, gone)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(np.diff(words.at)), pa.array(removed), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _joined(docs, find_repeats(docs)).mapInArrow(work, f"doc_id {docs.schema['id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated windows removed from text_col (remaining words joined by a space where any were); other columns as they came."""
    names = docs.columns
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in names if c != text_col]).alias("row"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, _, words in at.documents(batch.column("text"), at.WORDS):
                gone = _covered(batch, i, words)
                for k, left in enumerate(kept_words(words, gone)):
                    if gone[words.at[k] : words.at[k + 1]].any():
                        texts[i + k] = left.decode()
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    schema = rows.select("row", "text").schema
    out = _joined(rows, find_repeats(rows.select("id", "text"))).select("row", "text", "spans").mapInArrow(work, schema)
    return out.select(*[(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in names])
