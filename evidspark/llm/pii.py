"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and cue words in
one pass over an ASCII-lowered copy of a text that has its length; small deterministic
parsers expand each anchor to the boundaries of an email address, network address,
card, phone, account number or link and validate it.
Work is proportional to the anchors, and each parser remembers where it stopped, so
a span is never parsed twice.

Base kinds email, ip, card and phone follow the contract's expressions: leftmost,
not overlapping within a kind, failing ones dropped without a retry. The method adds
iban (country, check digits and up to 30 characters that pass modulo 97), account
(a cue such as "account no" or "ssn" in any case, maybe "number" or "no", then 6 to 17
digits) and url (a scheme that no letter or digit precedes, with its address: a link up
to white space, quotes or brackets, without the punctuation that ends a sentence; for
mailto an email address; for tel 5 to 15 digits), listed after the base kinds. Positions are code points, ends exclusive. A null text is empty and has
no spans; repeated rows are scanned each on its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidspark.llm.arrowtext import lean
from evidspark.runtime import ship

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "account", "url")
CUES = ("account no", "account number", "acct", "kontonummer", "ssn", "social security")
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "tel:")

#: Documents that are redacted at a time.
SLICE_ROWS = 256

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[ :]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:[ .:#]{0,2}(?i:number|no)(?![A-Za-z]))?[ .:#]{0,4}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])")
_LINK = re.compile(r"[A-Za-z0-9_\[\x80-\U0010ffff][^\s<>\"'`{}|\\^]*")
_MAILTO = re.compile(r"[A-Za-z0-9._%+-]+(?:@|%40)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_TEL = re.compile(r"\+?\(?[0-9](?:[().-]*[0-9]){4,14}(?![0-9])")
_automata: list = []


def _automaton():
    if not _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for c in "0123456789":
            a.add_word(c, ("digit", 1))
        a.add_word("@", ("at", 1))
        a.add_word("+", ("plus", 1))
        a.add_word("iban", ("iban", 4))
        for cue in CUES:
            a.add_word(cue, ("account", len(cue)))
        for scheme in SCHEMES:
            a.add_word(scheme, ("url", len(scheme)))
        a.make_automaton()
        _automata.append(a)
    return _automata[0]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _iban(value: str) -> bool:
    value = value.replace(" ", "")
    moved = value[4:] + value[:4]
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _lowered(text: str) -> str:
    """text with A-Z in lower case, as long as before."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _address_end(text: str, p: int, size: int, low: str) -> int:
    """The end of the address behind the scheme at p, or p if there is none."""
    if low.startswith(("mailto", "tel"), p):
        m = (_MAILTO if low[p] == "m" else _TEL).match(text, p + size)
        return m.end() if m else p
    if not (m := _LINK.match(text, p + size)):
        return p
    end = m.end()
    spare = {c: m[0].count(c) - m[0].count(o) for o, c in ("()", "[]")}
    while text[end - 1] in ".,;:!?" or spare.get(text[end - 1], 0) > 0:
        if text[end - 1] in spare:
            spare[text[end - 1]] -= 1
        end -= 1
    return end if end > p + size else p


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, each list in order of position."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    low = _lowered(text)
    for last, (anchor, size) in _automaton().iter(low):
        p = last - size + 1
        if anchor == "digit":
            if p >= done["ip"]:
                if m := _IP.match(text, p):
                    done["ip"] = m.end()
                    if all(map(_small, m[0].split("."))):
                        out["ip"].append(m.span())
                else:
                    done["ip"] = _DIGITS.match(text, p).end()
            if p >= done["card"]:
                if m := _CARD.match(text, p):
                    done["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and _luhn(digits):
                        out["card"].append(m.span())
                else:
                    done["card"] = p + 1
        elif anchor == "at":
            a = p
            while a > done["email"] and text[a - 1] in _LOCAL:
                a -= 1
            if a < p and (m := _DOMAIN.match(text, p + 1)):
                done["email"] = m.end()
                out["email"].append((a, m.end()))
        elif anchor == "plus":
            if p >= done["phone"] and (m := _PHONE.match(text, p)):
                done["phone"] = m.end()
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out["phone"].append(m.span())
        elif anchor == "url":
            if p >= done["url"] and not (p and text[p - 1].isalnum()) and (end := _address_end(text, p, size, low)) > p:
                done["url"] = end
                out["url"].append((p, end))
        elif p >= done[anchor]:
            m = (_IBAN if anchor == "iban" else _ACCOUNT).match(text, p + size)
            if m and (anchor == "account" or _iban(m[1])):
                done[anchor] = m.end()
                out[anchor].append(m.span(1))
    return out


def render(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def redact(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """text with every span, overlapping ones merged, replaced by its first kind in brackets."""
    merged: list[list] = []
    for a, b, k in sorted((a, b, k) for k in KINDS for a, b in spans[k]):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b, k])
    out, at = [], 0
    for a, b, k in merged:
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join(out) + text[at:] if out else text


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The op3 columns, for every row."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in BASE]
            digests, all_spans = [], []
            for text in batch.column("text"):
                spans = find_spans(text.as_py() or "")
                for c, k in zip(counts, BASE, strict=True):
                    c.append(len(spans[k]))
                digests.append(hashlib.sha256(render(spans, BASE).encode()).hexdigest())
                all_spans.append(render(spans, KINDS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(all_spans, pa.string())], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(work, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def redact_documents(docs: DataFrame, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with personal data in text_col replaced and count_col, if named, set to the new length; other columns as they came, null texts stay null."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for i in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(i, SLICE_ROWS)
                texts = [t and redact(t, find_spans(t)) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    out = docs.mapInArrow(lean(work), docs.schema)
    if count_col in docs.columns:
        out = out.withColumn(count_col, F.when(F.col(text_col).isNotNull(), F.length(text_col).cast(docs.schema[count_col].dataType)))
    return out
