"""Slow, obviously right versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import xxhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def components(nodes: list, links) -> dict:
    """The least node that links reach."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def fingerprint(text: str | None, width: int = 4) -> int:
    w = words(lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs: list[tuple[int, str | None]], radius: int = 4) -> dict[int, tuple[str, int]]:
    prints = {i: fingerprint(t) for i, t in docs}
    ids = sorted(prints)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= radius]
    group = components(ids, links)
    return {i: (f"{prints[i]:016x}", group[i]) for i in ids}


def kept_words(docs: list[tuple[int, str | None]], width: int = 20) -> dict[int, tuple[list[str], int]]:
    """By document: the kept words and the number of all words."""
    seen: set[tuple] = set()
    out = {}
    for i, text in sorted(docs):
        w = words(text)
        gone = set()
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            if key in seen:
                gone.update(range(p, p + width))
            seen.add(key)
        out[i] = [x for p, x in enumerate(w) if p not in gone], len(w)
    return out


def digest(kept: list[str]) -> str:
    return hashlib.sha256(" ".join(kept).encode()).hexdigest()


def prose(rng: random.Random, n: int, size: int = 500) -> str:
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def letters(rng: random.Random, n: int, size: int = 500) -> str:
    """Words without digits."""
    return " ".join("".join(chr(97 + int(d)) for d in str(rng.randrange(size))) + "z" for _ in range(n))


def copies(rng: random.Random, n: int = 60) -> list[tuple[int, str | None]]:
    """Documents with exact and near copies, shared passages, repeats inside, empty, null and short ones, and a long one."""
    out: list[tuple[int, str | None]] = []
    texts = [prose(rng, rng.randrange(5, 120)) for _ in range(n // 3)]
    passage = prose(rng, 40)
    for k in range(n):
        text = rng.choice(texts)
        kind = k % 6
        if kind == 1:
            w = text.split(" ")
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 2:
            text = f"{prose(rng, 10)}\n{passage}\t{prose(rng, 12)}"
        elif kind == 3:
            text = f"{text}  {text}"
        elif kind == 4:
            text = text.upper()
        out.append((k * 3 + 1, text))
    return out + [(1000, None), (1001, ""), (1002, " \n "), (1003, "one"), (1004, "one"), (1005, prose(rng, 8000)), (1006, "é" * 30 + " 日本語 " + passage)]


def rows_by(df, key: str) -> dict:
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r.asDict())
    return out
