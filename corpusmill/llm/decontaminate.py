"""Benchmark decontamination by template canonicalisation.

Texts become template tokens: lower-cased words, with a typed placeholder for each number (in digits or spelled out), each unit
that follows a number and each name (a capitalised word, at the start of a sentence unless it is a function word). Windows of template
tokens are hash-joined with those of the benchmark, so that questions with other numbers, names or
units still meet. A joined window counts only if its slots are consistent: within a document and item,
the same value of the item always stands for the same value of the document, and the other way round.
Items of one template whose slots are equal in the same places are looked for once.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import LOWER, lean, materialize, mix, pick, release, slices, span_hash, spans, table, window_hash, window_starts

WINDOW = 10
#: Items with fewer words, or of which fewer are left as a template, are looked for word by word; the shorter ones as a sentence or line of its own.
MIN_TOKENS = 5
#: Share of an item's template tokens that consistent windows must cover.
COVERAGE = 0.6
#: Benchmark text in one block; each block's windows are sent to all tasks. Blocks are taken in turn, and what one found is written before the next.
BLOCK_BYTES = 8 << 20

# Fixed values of English: units, numbers in words, and words that are no names where a sentence starts.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs pound pounds oz ounce ounces ton tons tonne tonnes "
    "ml cl l liter liters litre litres gal gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "c f k degree degrees percent pct usd eur gbp dollar dollars cent cents euro euros hz khz mhz ghz w kw mw v a j kj cal kcal pa kpa mph kph kmh"
).split()
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
OPENERS = (
    "a about after all also although an and any are as at be because before both but by can could did do does each either every few find first following for from given had has have having he her here his how however "
    "i if in is it its last let many may more most much my neither next no nor not now of on once only or other our out over please she should show since so some such suppose than that the their then there these they this those "
    "to under until up using was we were what when where whether which while who whose why will with would write yes yet you your"
).split()
NUMBER, UNIT, NAME = 1, 2, 3

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\n\"|"]] = True


def _hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    e = np.cumsum([len(w) for w in words])
    return np.sort(span_hash(data, e - np.array([len(w) for w in words]), e))


_UNIT_HASHES, _NUMBER_HASHES, _OPENER_HASHES = _hashes(UNITS), _hashes(NUMBERS), _hashes(OPENERS)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


_SLOT_HASH = mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x1234567))


@dataclass
class Tokens:
    template: np.ndarray  # hash of the word, or of the placeholder
    value: np.ndarray  # hash of the lower-cased word
    kind: np.ndarray  # 0, NUMBER, UNIT or NAME
    firsts: np.ndarray


def sentences(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each document as hashes, with their spans; the index of each document's first; which words open a document or sentence."""
    s, e, firsts = spans(_WORD[data], off)
    value = span_hash(LOWER[data], s, e)
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    opens = np.zeros(len(s), bool)
    opens[firsts[:-1][firsts[:-1] < firsts[1:]]] = True
    if len(s):
        opens[1:] |= stops[s[1:]] > stops[e[:-1]]
    return value, s, e, firsts, opens


def canonical(data: np.ndarray, off: np.ndarray, names: bool = True, slots: bool = True) -> Tokens:
    """Template tokens of each document. A word with a digit is a number; a run of numbers or of names is one slot.

    A name has a capital and then a small letter. Without slots every word stands for itself.
    """
    value, s, e, firsts, opens = sentences(data, off)
    kind = np.zeros(len(s), np.int8)
    if not slots or not len(s):
        return Tokens(value, value, kind, firsts)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    if names:
        second = np.minimum(s + 1, len(data) - 1)
        capital = _UPPER[data[s]] & (e - s > 1) & ~_UPPER[data[second]]  # SHOUTING holds no names
        capital &= ~(opens & _among(value, _OPENER_HASHES))
        kind[capital] = NAME
    kind[(digits[e] > digits[s]) | _among(value, _NUMBER_HASHES)] = NUMBER
    inside = np.ones(len(s), bool)
    inside[firsts[:-1][firsts[:-1] < firsts[1:]]] = False
    after = np.zeros(len(s), bool)
    after[1:] = kind[:-1] == NUMBER
    kind[_among(value, _UNIT_HASHES) & after & inside] = UNIT
    same = np.zeros(len(s), bool)
    same[1:] = (kind[1:] == kind[:-1]) & np.isin(kind[1:], (NUMBER, NAME)) & inside[1:]
    if same.any():
        lead = np.flatnonzero(~same)
        runs = np.diff(np.append(lead, len(s)))
        many = np.flatnonzero(runs > 1)
        for i in many.tolist():  # the value of a run of words stands for all of them
            part = value[lead[i] : lead[i] + runs[i]]
            value[lead[i]] = window_hash(part, len(part))[0]
        keep = ~same
        firsts = np.concatenate([[0], np.cumsum(keep)])[firsts]
        value, kind = value[keep], kind[keep]
    template = np.where(kind > 0, _SLOT_HASH[kind], value)
    return Tokens(template, value, kind, firsts)


class Index:
    """Windows of one block of benchmark items, by hash. Items shorter than a window are one window.

    Items of which too little is left as a template, like rows of numbers, are looked for word by word.
    """

    def __init__(self, items: list[tuple[str, str | None]], width: int = WINDOW, slots: bool = True) -> None:
        texts = [(t or "").encode() for _, t in items]
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        self.slots, self.width = slots, width
        tok, plain = canonical(data, off, slots=slots), canonical(data, off, names=False, slots=slots)
        self.literal: Index | None = None
        self.short: dict[int, dict[int, list[str]]] = defaultdict(lambda: defaultdict(list))  # by words: hash to items
        if slots:
            literal = canonical(data, off, slots=False)
            n_words = np.diff(literal.firsts)
            few = np.flatnonzero((np.diff(tok.firsts) < MIN_TOKENS) & (n_words >= MIN_TOKENS)).tolist()
            self.literal = Index([items[i] for i in few], width, slots=False) if few else None
            for i in np.flatnonzero((n_words > 0) & (n_words < MIN_TOKENS)).tolist():
                own = literal.value[literal.firsts[i] : literal.firsts[i + 1]]
                self.short[len(own)][int(window_hash(own, len(own))[0])].append(items[i][0])
        self.short = {n: dict(x) for n, x in self.short.items()}
        named = [i for i in range(len(items)) if (tok.kind[tok.firsts[i] : tok.firsts[i + 1]] == NAME).any()]
        # items with names are also there without them, for copies in one case only
        groups: dict[tuple, list[str]] = defaultdict(list)
        first: list[tuple[Tokens, int]] = []
        for source, i in [*((tok, i) for i in range(len(items))), *((plain, i) for i in named)]:
            key = self._form(source, i)
            if key not in groups:
                first.append((source, i))
            groups[key].append(items[i][0])
        self.members = [sorted(x) for x in groups.values()]
        parts = [slice(t.firsts[i], t.firsts[i + 1]) for t, i in first]
        self.sizes = np.array([p.stop - p.start for p in parts], np.int64)
        none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int8))
        self.tokens = tok = Tokens(*(np.concatenate([z, *(getattr(t, f)[p] for (t, _), p in zip(first, parts))]) for f, z in zip(("template", "value", "kind"), none)), np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64))
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        widths = np.where(self.sizes >= width, width, np.where(self.sizes >= MIN_TOKENS, self.sizes, 0))
        for w in sorted(set(widths.tolist()) - {0}):
            starts = window_starts(tok.firsts, w)
            owner = np.searchsorted(tok.firsts, starts, "right") - 1
            starts, owner = starts[widths[owner] == w], owner[widths[owner] == w]
            h = window_hash(tok.template, w)[starts]
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << 22, bool)
            seen[h >> np.uint64(42)] = True
            self.by_width[w] = (h[order], starts[order], owner[order], seen)

    @staticmethod
    def _form(tok: Tokens, i: int) -> tuple:
        """The template of an item, and which of its slots hold the same value."""
        part = slice(tok.firsts[i], tok.firsts[i + 1])
        kinds, values = tok.kind[part], tok.value[part]
        number: dict[tuple[int, int], int] = {}
        same = tuple(number.setdefault((k, v), len(number)) for k, v in zip(kinds.tolist(), values.tolist()) if k)
        return tok.template[part].tobytes(), same

    def search(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, str, float]]:
        """(document, item_id, coverage) with at least one consistent window."""
        for d, form, share in self.matches(canonical(data, off, slots=self.slots)):
            for item in self.members[form]:
                yield d, item, share
        if self.literal is not None:
            yield from self.literal.search(data, off)
        if self.short:
            value, _, _, firsts, opens = sentences(data, off)
            ends = np.append(opens, True)  # a word that opens, or the end of the last document
            for n, known in self.short.items():
                h = window_hash(value, n)
                keys = np.sort(np.array(list(known), np.uint64))
                at = np.flatnonzero(_among(h, keys) & opens[: len(h)] & ends[n : n + len(h)]) if len(h) else []
                for p in at:
                    if opens[p + 1 : p + n].any():
                        continue
                    for item in known[int(h[p])]:
                        yield int(np.searchsorted(firsts, p, "right") - 1), item, 1.0

    def matches(self, tok: Tokens) -> Iterator[tuple[int, int, float]]:
        n_docs = len(tok.firsts) - 1
        pairs: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
        for w, (hashes, starts, owner, seen) in self.by_width.items():
            mine = window_hash(tok.template, w)
            at = np.flatnonzero(seen[mine >> np.uint64(42)]) if len(mine) else np.zeros(0, np.int64)
            lo, hi = np.searchsorted(hashes, mine[at], "left"), np.searchsorted(hashes, mine[at], "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            doc = np.searchsorted(tok.firsts, at, "right") - 1
            inside = at + w <= tok.firsts[np.minimum(doc + 1, n_docs)]
            for p, d, a, b in zip(at[inside].tolist(), doc[inside].tolist(), lo[inside].tolist(), hi[inside].tolist()):
                for k in range(a, b):
                    q = int(starts[k])
                    if np.array_equal(tok.template[p : p + w], self.tokens.template[q : q + w]):
                        pairs[d, int(owner[k])].append((p, q, w))
        for (d, item), windows in pairs.items():
            yield d, item, self._coverage(tok, item, windows)

    def _coverage(self, tok: Tokens, item: int, windows: list[tuple[int, int, int]]) -> float:
        """Share of the item's tokens in windows whose slots agree, on the best alignment of document and item.

        An alignment may shift where words were inserted or deleted, by at most the item's size at a time.
        """
        size = int(self.sizes[item])
        shifts: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for p, q, w in sorted(windows):
            shifts[p - q].append((p, q, w))
        best = max(self._extend(tok, (0, {}, 0, 0), group)[0] for group in shifts.values())
        reach = -1
        union = 0
        for q, w in sorted({(q, w) for _, q, w in windows}):
            union += max(0, q + w - max(q, reach))
            reach = max(reach, q + w)
        if len(shifts) > 1 and union > best:
            best = max(best, self._chained(tok, size, shifts))
        return best / size

    def _extend(self, tok: Tokens, state: tuple[int, dict, int, int], group: list[tuple[int, int, int]]) -> tuple[int, dict, int, int]:
        """(covered tokens, values of slots, end in the document, end in the item) with the windows of one shift that agree added."""
        covered, bound, p_end, q_end = state
        for p, q, w in group:
            fresh = min(w, w - max(p_end - p, q_end - q)) if covered else w
            if fresh <= 0:
                continue
            slots = [j for j in range(w) if self.tokens.kind[q + j]]
            found = [((int(self.tokens.kind[q + j]), int(self.tokens.value[q + j])), int(tok.value[p + j])) for j in slots]
            local = dict(bound)
            if all(local.setdefault(k, v) == v and local.setdefault((-k[0], v), k[1]) == k[1] for k, v in found):
                covered, bound, p_end, q_end = covered + fresh, local, p + w, q + w
        return covered, bound, p_end, q_end

    def _chained(self, tok: Tokens, size: int, shifts: dict[int, list[tuple[int, int, int]]]) -> int:
        """Most tokens covered by runs of windows that follow each other in document and item."""
        runs: list[list[tuple[int, int, int]]] = []
        for group in shifts.values():
            for k, window in enumerate(group):
                if k and window[0] <= group[k - 1][0] + window[2]:
                    runs[-1].append(window)
                else:
                    runs.append([window])
        runs.sort()
        states: list[tuple[int, dict, int, int]] = []
        for k, run in enumerate(runs):
            p, q, _ = run[0]
            state = self._extend(tok, (0, {}, 0, 0), run)
            for before, last in zip(states, runs):
                near = abs((p - q) - (last[0][0] - last[0][1])) <= size
                if near and before[2] < run[-1][0] + run[-1][2] and before[3] < run[-1][1] + run[-1][2]:
                    state = max(state, self._extend(tok, before, run), key=lambda s: s[0])
            states.append(state)
        return max(s[0] for s in states)


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(doc_id, text, ...) with contaminated, n_items, item_id and coverage added to all columns.

    n_items counts the benchmark(item_id, text) items of which consistent windows cover at least
    `coverage`; item_id is the one covered best (the first in order of ties), coverage its share, or the
    best share below the limit with a null item_id. Null or empty texts and items match nothing. Items with fewer
    than MIN_TOKENS words match a sentence or line that equals them word for word. Repeated items and rows count once each.
    Columns of docs named like the added ones are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    added = ("contaminated", "n_items", "item_id", "coverage")
    names = [c for c in docs.columns if c.lower() not in added and (c == "text" or c.lower() != "text")]
    out = pick(docs, *names)
    for name, kind in zip(added, ("boolean", "bigint", "string", "double")):
        out = out.withColumn(name, F.lit({"boolean": False, "bigint": 0, "string": None, "double": 0.0}[kind]).cast(kind))
    out_type = out.schema
    schema = to_arrow_schema(out_type)
    items = pick(benchmark, "item_id", "text").where("text is not null").withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("")))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_bytes))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        index = Index(sorted((r["item_id"], r["text"]) for r in rows), width)
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for rows, data, off in slices(batches, limit=1 << 20):
                columns = {c: rows.column(rows.schema.get_field_index(c)).to_pylist() for c in added}
                best: dict[tuple[int, str], float] = {}
                for d, item, share in index.search(data, off):
                    key = d, item
                    best[key] = max(share, best.get(key, 0.0))
                for (d, item), share in sorted(best.items()):
                    hit = share >= coverage
                    if hit:
                        columns["contaminated"][d] = True
                        columns["n_items"][d] += 1
                    old = columns["item_id"][d]
                    if (hit, share) > (old is not None, columns["coverage"][d]) or (hit and share == columns["coverage"][d] and item < old):
                        columns["coverage"][d] = share
                        columns["item_id"][d] = item if hit else None
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in added else rows.column(i) for i, f in enumerate(schema)], schema=schema)

        before = out
        out = before.mapInArrow(lean(scan), out_type)
        if k < blocks - 1:  # one index at a time, in the driver and in the workers
            out = materialize(out)
            shared.destroy()
            release(before)
    return out


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document with the benchmark item it holds, if any."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "n_items", "item_id", "coverage")
