"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of at most about `max_train` labelled documents (chosen
by a hash of the id; the texts are whole) per language and bucket, and broadcasts a
matrix of log-probabilities: buckets x languages, so its size is fixed by the number
of languages. Scoring gathers the rows of the n-grams that a text has and sums them
per document.

Rows with a null label or a null id never train. A null text, or one without a
letter, gets `und` and score 0, as does everything if nothing could be learned. Ties
go to the label that sorts first. Repeated rows are scored each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidspark.llm import arrowtext as at
from evidspark.runtime import ship

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
MAX_TRAIN = 20_000
MAX_LANGUAGES = 1000
_SLICE = 1 << 20
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _cases() -> tuple[np.ndarray, np.ndarray]:
    """(lower case or 32 for non-letters, is a letter) of the code points below 65536."""
    if not _tables:
        low, letter = np.full(1 << 16, 32, np.uint32), np.zeros(1 << 16, bool)
        for c in range(1 << 16):
            x = chr(c)
            if x.isalpha():
                letter[c] = True
                y = x.lower()
                low[c] = ord(y) if len(y) == 1 else c
        _tables.append((low, letter))
    return _tables[0]


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram, its document, whether each document has a letter)."""
    n_docs = len(offsets) - 1
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    cut = heads[offsets]
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) != heads[-1]:  # not UTF-8; every byte is a point
        points, cut = raw.astype(np.uint32), offsets
    low, letter = _cases()
    small = points < 1 << 16
    known = np.where(small, points, 0)
    text = np.where(small, low[known], points)
    is_letter = np.where(small, letter[known], False)
    for c in np.unique(points[~small]):
        if chr(int(c)).isalpha():
            is_letter |= points == c
        else:
            text[points == c] = 32
    doc = np.repeat(np.arange(n_docs), np.diff(cut))
    has = np.zeros(n_docs, bool)
    has[doc[is_letter]] = True
    buckets, owners = [], []
    for n in ORDERS:
        if len(text) < n:
            continue
        k = len(text) - n + 1
        h = np.full(k, 0x811C9DC5 + n, np.uint32)
        some = np.zeros(k, bool)
        for j in range(n):
            h ^= text[j : j + k]
            h *= np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            some |= is_letter[j : j + k]
        some &= doc[:k] == doc[n - 1 :]
        buckets.append(h[some] & np.uint32(BUCKETS - 1))
        owners.append(doc[:k][some])
    if not buckets:
        return np.empty(0, np.uint32), np.empty(0, np.int64), has
    return np.concatenate(buckets), np.concatenate(owners), has


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """(labels, log-probabilities as float32 [BUCKETS, labels], with the log prior in one more row)."""
    ship(labelled.sparkSession)
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    total = rows.select(id_col).count()
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30))
    if total > max_train:
        rows = rows.where(place < int((1 << 30) * (max_train / total)))
    picked = rows.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch.column("label").to_pylist()
            raw, offsets = at.buffers(batch.column("text"))
            for i, j in at.slices(offsets, _SLICE):
                b, d, _ = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                own = np.array(labels[i:j], object)[d]
                for label in set(labels[i:j]):
                    had = sums.setdefault(label, np.zeros(BUCKETS + 1, np.int64))
                    had[:-1] += np.bincount(b[own == label], minlength=BUCKETS)
                    had[-1] += labels[i:j].count(label)
        for label, had in sums.items():
            at_ = np.flatnonzero(had)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at_), pa.string()), pa.array(at_.astype(np.int32)), pa.array(had[at_])], names=["label", "bucket", "n"])

    summed = picked.mapInArrow(count, "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    names = sorted(r["label"] for r in summed.select("label").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    counts = np.zeros((BUCKETS + 1, len(names)), np.float64)
    got = summed.toArrow()  # at most BUCKETS + 1 rows a label
    col = {x: i for i, x in enumerate(names)}
    if got.num_rows:
        counts[got.column("bucket").to_numpy(), [col[x] for x in got.column("label").to_pylist()]] = got.column("n").to_numpy()
    out = np.empty((BUCKETS + 1, len(names)), np.float32)
    if names:
        out[:-1] = np.log((counts[:-1] + 0.5) / (counts[:-1].sum(0) + 0.5 * BUCKETS))
        out[-1] = np.log(counts[-1] / counts[-1].sum())
    return names, out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score for every row."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sent = spark.sparkContext.broadcast(model)  # (BUCKETS + 1) * 4 bytes a label, MAX_LANGUAGES labels at most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, log = sent.value
        labels = np.array([*names, "und"], object)
        for batch in batches:
            raw, offsets = at.buffers(batch.column("text"))
            for i, j in at.slices(offsets, _SLICE):
                b, d, has = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                best, p = np.full(j - i, len(names)), np.zeros(j - i)
                if names:
                    sums = np.stack([np.bincount(d, log[b, c], j - i) for c in range(len(names))], 1) + log[-1]
                    top = sums.argmax(1)
                    share = 1 / np.exp(np.minimum(sums - sums.max(1, keepdims=True), 0)).sum(1)
                    best, p = np.where(has, top, best), np.where(has, share, p)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(labels[best].tolist(), pa.string()), pa.array(p, pa.float64())], names=["id", "lang_pred", "score"])

    return docs.mapInArrow(score, f"id {docs.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by folds; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """The op2 columns."""
    model = train(docs.where(~held_out()))
    return predict(docs, model).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")
