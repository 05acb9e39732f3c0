"""Benchmark decontamination with suffix arrays over the training documents.

Every task takes its documents in shards of bounded size and builds a suffix array
over all words of a shard, ordered by prefix doubling on ranks until at least a window's
words are told apart. Every suffix of every item is looked up by binary search, one word
deeper at a time, which narrows all intervals together; suffixes that begin with the same
window are one lookup. What is left after the last word of the window are all verbatim
occurrences, with their places. Occurrences that go on side by side in one item and the
document are one match, so each match is followed to its full length: `matches` has the
longest one of each item with its place, longest_match the longest of all.

The benchmark is broadcast in blocks of at most `block_bytes` of text. A larger
benchmark takes a pass for each block, over documents that are written with a number for
each row, and the hits of a row are merged.

Words are lower-cased runs of ASCII letters and digits and of anything outside
ASCII. A window is `window` consecutive words of an item; a shorter item with at
least one word is one window. Null texts have no words and are never hit. Items
without words match nothing. Repeated rows are judged each on its own; a repeated
item_id counts once. Items without an id hit like any other, count together as one
item and add nothing to the list of ids that is hashed. Empty tables give no rows (no documents) or no hits (no items).
Only the named columns are read, so extra columns never clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidspark.llm import arrowtext as at
from evidspark.runtime import materialize, ship

WINDOW = 10
BLOCK_BYTES = 8 << 20
#: Most bytes of text in one suffix array, unless a single document has more.
SHARD_BYTES = 1 << 20


def _sorted_ids(ids: set) -> list:
    """The ids in order, the missing one last."""
    return sorted(ids, key=lambda x: (x is None, x or ""))


class Benchmark:
    """The distinct windows of a block of items, as rows of word hashes, and where each one occurs."""

    def __init__(self, ids: list, texts: list, window: int):
        self.window = window
        self.ids = [x if x is None else str(x) for x in ids]
        found: dict[tuple, list[tuple[int, int]]] = {}
        for _, _, words in at.documents(pa.array(texts, pa.large_string()), at.ALNUM_LOWER, 1 << 62):
            h = words.hashes().tolist()
            for i in range(words.n_docs):
                own = h[words.at[i] : words.at[i + 1]]
                n = min(window, len(own))
                for k in range(len(own) - n + 1 if n else 0):
                    found.setdefault(tuple(own[k : k + n]), []).append((i, k))
        keys = sorted(found)
        self.length = np.array([len(k) for k in keys], np.int64)
        self.words = np.zeros((len(keys), window), np.uint64)
        for i, k in enumerate(keys):
            self.words[i, : len(k)] = k
        self.at = np.cumsum([0, *(len(found[k]) for k in keys)])
        places = np.array([x for k in keys for x in found[k]], np.int64).reshape(-1, 2)
        self.item, self.offset = places[:, 0], places[:, 1]


class SuffixArray:
    """All suffixes of a shard in order of their first words, `depth` at least."""

    def __init__(self, words: np.ndarray, left: np.ndarray, depth: int):
        self.words, self.left = words, left
        _, rank = np.unique(words, return_inverse=True)
        n, self.at = len(words), np.argsort(rank)
        step = 1
        while step < depth:
            # By twice as many words: the rank of the suffix, then that of what follows; 0 past the document's end.
            after = np.zeros(n, np.int64)
            after[:-step] = rank[step:] + 1
            after[left <= step] = 0
            key = rank * (int(rank.max()) + 2) + after
            self.at = np.argsort(key)
            key = key[self.at]
            rank = np.empty(n, np.int64)
            rank[self.at] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            step *= 2

    def find(self, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
        """For every window the interval of the array whose suffixes start with it."""
        n = len(bench.length)
        lo, hi = np.zeros(n, np.int64), np.full(n, len(self.at), np.int64)
        for d in range(bench.window):
            live = np.flatnonzero((bench.length > d) & (lo < hi))
            want = bench.words[live, d]
            lo[live], hi[live] = self._bound(d, want, lo[live], hi[live], False), self._bound(d, want, lo[live], hi[live], True)
        return lo, hi

    def _bound(self, d: int, want: np.ndarray, lo: np.ndarray, hi: np.ndarray, upper: bool) -> np.ndarray:
        """First place of each interval whose word d is not below want, or above it."""
        lo, hi = lo.copy(), hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            place = self.at[mid]
            inside = self.left[place] > d
            value = np.where(inside, self.words[np.where(inside, place + d, 0)], np.uint64(0))
            right = inside & (value == want[live]) if upper else np.zeros(len(live), bool)
            right |= ~inside | (value < want[live])
            lo[live] = np.where(right, mid + 1, lo[live])
            hi[live] = np.where(right, hi[live], mid)
            live = live[lo[live] < hi[live]]
        return lo


def longest_matches(bench: Benchmark, which: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, first word, length) of all matches of the windows `which` at `place`, each to its full length."""
    n = bench.at[which + 1] - bench.at[which]
    hit = np.repeat(np.arange(len(which)), n)
    own = bench.at[which[hit]] + np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)
    item, p, length = bench.item[own], place[hit], bench.length[which[hit]]
    aside = p - bench.offset[own]
    order = np.lexsort((p, aside, item))
    item, aside, p, length = item[order], aside[order], p[order], length[order]
    new = np.ones(len(p), bool)
    new[1:] = (item[1:] != item[:-1]) | (aside[1:] != aside[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p))[: len(first)] - 1
    return item[first], p[first], p[last] - p[first] + length[last]


def covered(n: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of n words lie in an interval."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, start + length, -1)
    return np.cumsum(step[:-1]) > 0


#: What is told of a document: hit words as merged intervals [start, end), the items, the longest match of each item.
FOUND = "n_words bigint, spans array<array<bigint>>, items array<string>, matches array<struct<item:string,start:bigint,length:bigint>>"
_SPANS = pa.list_(pa.list_(pa.int64()))
_MATCHES = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
#: Most pairs of a place and an item's occurrence that are followed at a time, unless a single document has more.
MOST_PAIRS = 1 << 21


def hits(column: pa.Array, bench: Benchmark) -> Iterator[tuple[int, list[int], list[list[list[int]]], list[list[str | None]], list[list[tuple]]]]:
    """Per slice of documents: first document, word counts, merged hit intervals, item ids, longest match of each item."""
    raw, offsets = at.buffers(column)
    for i, j in at.slices(offsets, SHARD_BYTES):
        words = at.Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], at.ALNUM_LOWER)
        counts = np.diff(words.at).tolist()
        spans: list[list[list[int]]] = [[] for _ in counts]
        best: list[dict[str | None, tuple[int, int]]] = [{} for _ in counts]
        h = words.hashes()
        if len(h) and len(bench.length):
            array = SuffixArray(h, words.left(), bench.window)
            lo, hi = array.find(bench)
            n = hi - lo
            which = np.repeat(np.arange(len(n)), n)
            place = array.at[np.repeat(lo, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
            mask = covered(len(h), place, bench.length[which])
            # Runs of hit words inside a document.
            edge = np.zeros(len(h) + 1, bool)
            edge[words.at] = True
            first = np.flatnonzero(mask & (~np.concatenate([[False], mask[:-1]]) | edge[:-1]))
            last = np.flatnonzero(mask & (~np.concatenate([mask[1:], [False]]) | edge[1:])) + 1
            run_doc = np.searchsorted(words.at, first, "right") - 1
            base = words.at[run_doc]
            for d, a, b in zip(run_doc.tolist(), (first - base).tolist(), (last - base).tolist(), strict=True):
                spans[d].append([a, b])
            order = np.argsort(place, kind="stable")
            which, place = which[order], place[order]
            pairs = np.concatenate([[0], np.cumsum(bench.at[which + 1] - bench.at[which])])
            of_doc = np.searchsorted(place, words.at)
            for a, b in at.slices(pairs[of_doc], MOST_PAIRS):
                part = slice(of_doc[a], of_doc[b])
                item, start, length = longest_matches(bench, which[part], place[part])
                doc = np.searchsorted(words.at, start, "right") - 1
                for d, k, p, size in zip(doc.tolist(), item.tolist(), (start - words.at[doc]).tolist(), length.tolist(), strict=True):
                    name = bench.ids[k]
                    best[d][name] = min(best[d].get(name, (0, 0)), (-size, p))
        items = [_sorted_ids(set(x)) for x in best]
        yield i, counts, spans, items, [[(name, found[name][1], -found[name][0]) for name in names] for names, found in zip(items, best, strict=True)]


def _scan(bench: Callable[[], Benchmark]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (id, row, text) to id, row and FOUND."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, counts, spans, items, matches in hits(batch.column("text"), bench()):
                told = [[dict(zip(("item", "start", "length"), m, strict=True)) for m in x] for x in matches]
                own = [batch.column(c).slice(i, len(counts)) for c in ("id", "row")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string())), pa.array(told, _MATCHES)], names=["id", "row", "n_words", "spans", "items", "matches"])

    return scan


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list, list]]:
    ids, texts, held = [], [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    for r in rows.toLocalIterator():
        size = len(r["t"] or "") * 4
        if ids and held + size > block_bytes:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(r["i"])
        texts.append(r["t"] or "")
        held += size
    if ids:
        yield ids, texts


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, n_words, spans of hit words (merged, [start, end)), items, matches, longest."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.lit(0).cast("bigint").alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {docs.schema['id'].dataType.simpleString()}, row bigint, {FOUND}"
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    first = next(blocks, ([], []))
    second = next(blocks, None)
    if second is not None:
        docs = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = None
    for ids, texts in (first, *([second, *blocks] if second is not None else [])):
        sent = spark.sparkContext.broadcast(Benchmark(ids, texts, window))  # at most block_bytes of text
        part = docs.mapInArrow(at.lean(_scan(lambda sent=sent: sent.value)), schema)
        found = part if found is None else found.unionByName(part)
    if second is not None:
        found = found.groupBy("row", "id", "n_words").agg(
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.flatten(F.collect_list("matches")).alias("matches"),
        )
        # Spans that touch or overlap become one.
        join = F.aggregate("spans", F.array().cast("array<array<bigint>>"), _append)
        found = found.withColumn("spans", join)
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["length"])), F.lit(0).cast("bigint"))
    return found.select("id", "n_words", "spans", "items", "matches", longest.alias("longest"))


def _append(held: Column, span: Column) -> Column:
    """held, in order, with a span that doesn't begin before its last one."""
    last = F.try_element_at(held, F.lit(-1))
    wider = F.concat(F.slice(held, F.lit(1), F.size(held) - 1), F.array(F.array(last[0], F.greatest(last[1], span[1]))))
    return F.when((F.size(held) > 0) & (span[0] <= last[1]), wider).otherwise(F.concat(held, F.array(span)))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the documents that hold a benchmark window; all columns as they came, and no shuffle."""
    spark = docs.sparkSession
    ship(spark)
    schema = docs.schema
    for ids, texts in _blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = spark.sparkContext.broadcast(Benchmark(ids, texts, window))  # at most block_bytes of text

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dirty = np.concatenate([[bool(x) for x in items] for _, _, _, items, _ in hits(pc.cast(batch.column(text_col), pa.string()), sent.value)] or [[]]).astype(bool)
                yield batch.filter(pa.array(~dirty))

        docs = docs.mapInArrow(at.lean(clean), schema)
    return docs


def digest(found: DataFrame) -> DataFrame:
    """The op7 columns."""
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + (x[1] - x[0])).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
        F.col("longest").alias("longest_match"),
    )
