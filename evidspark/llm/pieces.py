"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

One pass over a word's characters: at each position the automaton's output links name
every piece that ends there, and each relaxes the best score of the position from the
best score of the position where it starts. For a unigram model the score is the sum
of the pieces' log-probabilities. A merge (BPE) model has no such sums: a segmentation
is right if no earlier merge would have crossed any of its boundaries, so there a piece
is accepted if it may stand next to the last piece before it, the longest first, which
gives the merges' own result in the same pass. Characters that no piece covers become
byte pieces (or the unknown piece if the model has none).

Pieces never cross the start of a run of spaces or hold a line break (checked when the
model is read), so a text is cut there and each distinct word is encoded once per worker; the memory of
words is bounded and only saves time.

A null text has null ids; an empty one has none. Decoding gives back the text exactly
but for U+2581, which the model can't tell from a space; models that normalize or
squeeze white space are refused. Repeated rows and extra columns are no special case.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidspark.llm.arrowtext import lean
from evidspark.runtime import ship

#: Where the public vocabulary lies; a parameter of every entry point.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MOST_WORDS = 250_000
SPACE = "▁"
_WORD = re.compile("\n+| +[^ \n]*|[^ \n]+")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        else:
            raise ValueError("not a model file")
        yield key >> 3, value


class Model:
    """Pieces with scores and kinds, as read from a model file's bytes."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.bpe, self.dummy, self.squeeze, normalizer = False, True, True, b""
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = v
                    elif n == 3:
                        kind = v
                self.pieces.append((piece, score, kind))
            elif number == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                spec = dict(_fields(value))
                self.dummy, self.squeeze, normalizer = bool(spec.get(3, 1)), bool(spec.get(4, 1)), spec.get(2, b"")
        if normalizer or self.squeeze:
            raise ValueError("only models that keep their text are supported")
        if any(SPACE in p.lstrip(SPACE) for p, _, k in self.pieces if k in (NORMAL, USER)):
            raise ValueError("a piece crosses the start of a word")
        if self.bpe and any(k == USER for _, _, k in self.pieces):
            raise ValueError("merge models with user pieces are not supported")
        if any("\n" in p for p, _, k in self.pieces if k in (NORMAL, USER)):
            raise ValueError("a piece holds a line break")
        self.byte = [-1] * 256
        self.unknown = 0
        for i, (p, _, kind) in enumerate(self.pieces):
            if kind == BYTE:
                self.byte[int(p[1:-1], 16)] = i
            elif kind == UNKNOWN:
                self.unknown = i


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.automaton = ahocorasick.Automaton()
        self.rank: dict[str, tuple[float, int]] = {}
        for i, (piece, score, kind) in enumerate(model.pieces):
            if kind in (NORMAL, USER):
                self.automaton.add_word(piece, (len(piece), i, score))
                self.rank[piece] = (score, i)
        self.automaton.make_automaton()
        self.text = [p for p, _, _ in model.pieces]
        #: When merges make a piece; -1 for single characters, which are there from the start.
        turns = {x: i for i, x in enumerate(sorted({-s for _, s, _ in model.pieces}))}
        self.turn = [turns[-s] if len(p) > 1 else -1 for p, s, _ in model.pieces]
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}
        covered = "".join(sorted({c for p in self.rank for c in p if p == c}))
        self.foreign = re.compile(f"([^{re.escape(covered)}])")
        self.raw = []
        for p, _, kind in model.pieces:
            if kind == BYTE:
                self.raw.append(bytes([int(p[1:-1], 16)]))
            elif kind in (NORMAL, USER):
                self.raw.append(p.replace(SPACE, " ").encode())
            else:
                self.raw.append(b" \xe2\x81\x87 " if kind == UNKNOWN else b"")
        self.known = _Words(self)

    def _bytes(self, c: str) -> list[int]:
        ids = [self.model.byte[b] for b in c.encode()]
        return [self.model.unknown] if -1 in ids else ids

    def _parts(self, piece: int) -> tuple[int, int] | None:
        """The two pieces that the last merge of this piece joins; None if no merges lead to it."""
        if piece not in self.splits:
            parts, last = list(self.text[piece]), None
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    found = self.rank.get(parts[i] + parts[i + 1])
                    if found and (best is None or found[0] > best):
                        best, at = found[0], i
                if at < 0:
                    break
                last = parts[at], parts[at + 1]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = len(parts) == 1 and last and all(x in self.rank for x in last)
            self.splits[piece] = (self.rank[last[0]][1], self.rank[last[1]][1]) if known else None
        return self.splits[piece]

    def _made(self, piece: int) -> bool:
        return self.turn[piece] < 0 or self._parts(piece) is not None

    def _adjoin(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= MOST_WORDS:
                self.fits.clear()
            found = self.fits[key] = self._apart(a, b)
        return found

    def _apart(self, a: int, b: int) -> bool:
        """Whether pieces a, b stay as they are when they stand next to each other.

        Going back through the merges that made them, latest first, no merge across their
        border may come before the one that hides its two parts.
        """
        if not self._made(b):
            return False
        text, turn, limit = self.text, self.turn, 1e18
        while True:
            found = self.rank.get(text[a] + text[b])
            if found and turn[found[1]] < limit:
                return False
            if turn[a] > turn[b]:
                limit, a = turn[a], self._parts(a)[1]
            elif turn[b] < 0:
                return True
            else:
                limit, b = turn[b] + 0.5, self._parts(b)[0]

    def encode_word(self, word: str) -> list[int]:
        """Ids of a word whose spaces are already marked."""
        if not self.foreign.search(word):
            return self._covered(word)
        out: list[int] = []
        for k, part in enumerate(self.foreign.split(word)):  # no piece holds a foreign character
            out += self._bytes(part) if k % 2 else self._covered(part)
        return out

    def _covered(self, word: str) -> list[int]:
        """The best way through a word whose every character is a piece."""
        n = len(word)
        piece_at, start_at = [-1] * (n + 1), [-1] * (n + 1)
        if self.model.bpe:
            fits, made, adjoin = self.fits, self._made, self._adjoin
            for last, (size, piece, _) in self.automaton.iter(word):  # by end, then longest first
                if start_at[last + 1] < 0:
                    j = last + 1 - size
                    if j:
                        before = piece_at[j]
                        if before < 0:
                            continue
                        ok = fits.get(before << 32 | piece)
                        if ok is None:
                            ok = adjoin(before, piece)
                    else:
                        ok = made(piece)
                    if ok:
                        piece_at[last + 1], start_at[last + 1] = piece, j
        else:
            best = [0.0] + [-1e300] * n
            for last, (size, piece, score) in self.automaton.iter(word):
                j = last + 1 - size
                if best[j] + score > best[last + 1]:
                    best[last + 1], piece_at[last + 1], start_at[last + 1] = best[j] + score, piece, j
        out = []
        while n > 0:
            out.append(piece_at[n])
            n = start_at[n]
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        text = text.replace(SPACE, " ")  # the model sees no difference
        if self.model.dummy:
            text = " " + text
        known, ids = self.known, []
        for w in _WORD.findall(text):
            ids += known[w]
        return ids

    def decode(self, ids: list[int] | np.ndarray) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.model.dummy and text.startswith(" ") else text


class _Words(dict):
    """Ids by word; when it is full, words not asked for since the last time are forgotten."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.old = codec, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MOST_WORDS:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        if ids is None:
            ids = tuple(self.codec.encode_word(word.replace(" ", SPACE)))
        self[word] = ids
        return ids


_codecs: dict[str, Codec] = {}


def codec(data: bytes) -> Codec:
    """The worker's codec of a model; it stays between tasks."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(Model(data))
    return _codecs[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """id and ids array<int> for every row; the model file is read on the driver and broadcast."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sent = spark.sparkContext.broadcast(_read(model_path))  # one vocabulary, half a megabyte

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                texts = batch.column("text").slice(i, 256).to_pylist()
                ids = [None if t is None else np.array(c.encode(t), np.int32) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, 256), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return docs.mapInArrow(lean(work), f"id {docs.schema['id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """id and text for every row of (id, ids)."""
    ship(encoded.sparkSession)
    sent = encoded.sparkSession.sparkContext.broadcast(_read(model_path))  # one vocabulary, half a megabyte

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value)
        for batch in batches:
            texts = [None if x.as_py() is None else c.decode(x.values.to_numpy()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    encoded = encoded.select("id", "ids")
    return encoded.mapInArrow(work, f"id {encoded.schema['id'].dataType.simpleString()}, text string")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, n_byte_pieces, ids_sha256 (little-endian int32) and whether decoding gives the text back."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sent = spark.sparkContext.broadcast(_read(model_path))  # one vocabulary, half a megabyte

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value)
        is_byte = np.array([k == BYTE for _, _, k in c.model.pieces])
        for batch in batches:
            n, fallback, digest, same = [], [], [], []
            for t in batch.column("text"):
                t = t.as_py() or ""
                plain = c.encode(t)
                ids = np.array(plain, np.int32)
                n.append(len(ids))
                fallback.append(int(is_byte[ids].sum()))
                digest.append(hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest())
                same.append(c.decode(plain) == t)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(fallback, pa.int64()), pa.array(digest, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "n_byte_pieces", "ids_sha256", "round_trip"])

    return docs.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, n_byte_pieces bigint, ids_sha256 string, round_trip boolean")
