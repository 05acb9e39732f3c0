"""Plain-loop versions of the contracts, written from their text alone."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits: str) -> bool:
    values = [int(c) for c in digits][::-1]
    return sum(values[::2] + [sum(divmod(2 * v, 10)) for v in values[1::2]]) % 10 == 0


def pii(text: str | None) -> tuple:
    text, spans = text or "", {"email": [], "ip": [], "card": [], "phone": []}
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        spans["email"].append(m.span())
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            spans["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            spans["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans["phone"].append(m.span())
    return (*(len(v) for v in spans.values()), sha(",".join(f"{k}:{a}:{b}" for k, v in spans.items() for a, b in v)))


def quality(text: str | None) -> tuple:
    words = WORD.findall(text or "")
    seen: set[str] = set()
    dup = 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    where: dict[tuple, list[int]] = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i : i + 8]), []).append(i)
    again = {p for v in where.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again), n < 20 or 100 * len(again) > 30 * n)


def secrets(text: str | None) -> tuple:
    text, spans = text or "", []
    kinds = (
        (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
        (r"AKIA[A-Z0-9]+", 0, 20),
        (r"[0-9a-f]+", 0, 24),
    )
    names, counts = ("assign", "access", "hex"), []
    for k, (pattern, group, least) in enumerate(kinds):
        own = [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
        counts.append(len(own))
        spans += own
    return (*counts, sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))))


def windows(docs: list[tuple[int, str | None]], n: int = 13) -> dict[int, tuple]:
    words = {d: WORD.findall(t or "") for d, t in docs}
    first: dict[tuple, int] = {}
    for d, w in words.items():
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            first[key] = min(d, first.get(key, d))
    out = {}
    for d, w in words.items():
        gone = {p for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < d for p in range(i, i + n)}
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def near_dups(docs: list[tuple[int, str | None]]) -> dict[int, tuple]:
    sets: dict[int, frozenset] = {}
    for d, t in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = WORD.findall(low)
        sets[d] = frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])
    top = {d: d for d in sets}

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    number: dict[tuple, int] = {}
    bits = {d: sum(1 << number.setdefault(g, len(number)) for g in s) for d, s in sets.items()}
    order = sorted(d for d in sets if sets[d])
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            n = (bits[a] & bits[b]).bit_count()
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def alnum_words(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def decontaminate(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = 10) -> dict[int, tuple]:
    where: dict[tuple, set[str]] = {}
    for i, t in items:
        w = alnum_words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            where.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w = alnum_words(t)
        hit, found = set(), set()
        for n in {len(x) for x in where}:
            for k in range(len(w) - n + 1):
                if (names := where.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= names
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def longest_match(text: str | None, items: list[tuple[int, str | None]], window: int = 10) -> int:
    """Longest common run of words of the text and one item, from a window (or a whole shorter item) on."""
    w, best = alnum_words(text), 0
    for _, t in items:
        v = alnum_words(t)
        before = [0] * (len(v) + 1)
        for x in w:
            now = [0] * (len(v) + 1)
            for k, y in enumerate(v):
                now[k + 1] = before[k] + 1 if x == y else 0
            before = now
            if v and max(now) >= min(window, len(v)):
                best = max(best, max(now))
    return best
