"""Packing documents into fixed-length sequences: shortest pack first over the length histogram.

Documents are tokenized once and cut into pieces of at most the sequence length. Only the
histogram of piece lengths reaches the driver, which is as long as a sequence at most. There,
lengths are placed longest first, all pieces of one length at a time, each into the shortest pack
that has room, and the counts of packing patterns are updated. Patterns are joined back to the
pieces by their rank among the pieces of the same length.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from struct import pack as struct_pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import lean, materialize, pick, table

SEQUENCE = 2048
END = 1
#: Words whose ids a worker remembers.
CACHE = 150_000
#: Characters of a text that are split into words at a time.
SEGMENT = 1 << 16
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Odd(Exception):
    """White space that splitting at single spaces would treat differently."""


class Encoder:
    """Texts to packed ids (little-endian uint32) of a byte-level BPE in the tokenizers JSON format.

    Pre-tokens start at single spaces, so words between them are encoded once and remembered.
    Texts with other white space before a space, or with an added token's string, are encoded as a whole.
    """

    def __init__(self, definition: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(definition)
        spec = json.loads(definition)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = self._ranks(spec)
        if self.fast is not None:
            self.fast = tiktoken.Encoding("corpusmill", pat_str=_PATTERN, mergeable_ranks=self.fast, special_tokens={}).encode_ordinary
        fast = self.fast

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                if not word or word[-1].isspace():
                    raise _Odd
                ids = fast(" " + word)
                out = struct_pack(f"<{len(ids)}I", *ids)
                if len(self) < CACHE:
                    self[word] = out
                return out

        self.words = Words().__getitem__

    @staticmethod
    def _ranks(spec: dict) -> dict[bytes, int] | None:
        """Ids by bytes, if merges are ranked by id and nothing but a plain byte-level split goes before."""
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or (spec.get("post_processor") or {}).get("type", "ByteLevel") != "ByteLevel" or model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("ignore_merges"):
            return None
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in keep)}
        added = {t["content"] for t in spec["added_tokens"]}
        vocab = {k: v for k, v in model["vocab"].items() if k not in added}
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged) or len(merged) + 256 != len(vocab):
            return None
        return {bytes(byte[c] for c in k): v for k, v in vocab.items()}

    def _by_words(self, text: str) -> Iterator[bytes]:
        at = text.find(" ")
        first = text if at < 0 else text[:at]
        if first and first[-1].isspace():
            raise _Odd
        ids = self.fast(first)
        yield struct_pack(f"<{len(ids)}I", *ids)
        while at >= 0:  # text[at] is a space
            end = text.find(" ", at + SEGMENT)
            yield b"".join(map(self.words, text[at + 1 : end if end >= 0 else None].split(" ")))
            at = end

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return b"".join(self._by_words(text))
            except _Odd:
                ids = self.fast(text)
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return struct_pack(f"<{len(ids)}I", *ids)


_ENCODERS: dict[int, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """One encoder for each definition and worker."""
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


def shortest_pack_first(histogram: dict[int, int], length: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of the packing patterns; every length occurs as often as in the histogram."""
    packs: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        # each of the shortest packs takes one; it is then longer and comes up again in its turn
        for t in range(length - size + 1):
            while left and packs.get(t):
                count, pattern = packs[t].pop(0)
                used = min(count, left)
                if used < count:
                    packs[t].insert(0, (count - used, pattern))
                packs[t + size].append((used, (*pattern, size)))
                left -= used
        # what is left starts new packs, several of a size together
        each = length // size
        if left:
            full, rest = divmod(left, each)
            if full:
                packs[each * size].append((full, (size,) * each))
            if rest:
                packs[rest * size].append((1, (size,) * rest))
    return [x for t in sorted(packs, reverse=True) for x in packs[t]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """For pieces of each length, by rank: the first sequence and the offset. Sorted by length and rank."""
    rows, used, base = [], defaultdict(int), 0
    for count, pattern in patterns:
        offset = 0
        for size in pattern:
            rows.append((size, used[size], base, offset))
            used[size] += count
            offset += size
        base += count
    rows.sort()
    names = ("length", "rank", "sequence", "offset")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def tokenize_pieces(docs: DataFrame, definition: str, length: int = SEQUENCE, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, part, local_rank[, ids]) of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    tail = struct_pack("<I", end)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int64()), ("local_rank", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(shared.value), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                out: list[list] = [[] for _ in schema]
                for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1)):
                    ids = encode(text.as_py()) + tail
                    total = len(ids) // 4
                    for start in range(0, total, length):
                        piece = ids[4 * start : 4 * (start + length)]
                        size = len(piece) // 4
                        values = [doc_id, start, size, zlib.crc32(piece), total, part, seen[size], piece]
                        seen[size] += 1
                        for column, v in zip(out, values):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    ddl = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part bigint, local_rank bigint"
    return pick(docs, "doc_id", "text").mapInArrow(lean(scan), ddl + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer_path: str, length: int = SEQUENCE, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): one row per piece.

    A document's ids are those of the tokenizer (a null text has none), then end. Sequences hold at most
    length ids; pieces lie without gaps from offset 0, the rest is padding. Documents
    repeated under one doc_id, or with a null one, are packed like others. No rows give no rows.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    pieces = materialize(tokenize_pieces(docs, definition, length, end, with_ids))
    counts = materialize(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = slots(shortest_pack_first(histogram, length))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    ranked = pieces.join(counts.select("part", "length", before.alias("before")), ["part", "length"])
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    ranked = ranked.select(*columns, (F.col("before") + F.col("local_rank")).alias("rank"))
    shared = docs.sparkSession.sparkContext.broadcast(where)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        keys = (w["length"] << 48) + w["rank"]
        for rows in batches:
            size, rank = (np.array(rows.column(rows.schema.get_field_index(c))) for c in ("length", "rank"))
            at = np.searchsorted(keys, (size << 48) + rank, "right") - 1
            added = [pa.array(w["sequence"][at] + rank - w["rank"][at]), pa.array(w["offset"][at])]
            kept = [rows.column(rows.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, *added], names=[*columns, "sequence_id", "offset"])

    ddl = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * with_ids
    return ranked.mapInArrow(place, ddl + ", sequence_id bigint, offset bigint")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
