"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are 64-bit majority votes over the XXH64 hashes of word shingles. Distinct
fingerprints are compared in blocks that agree on some of their bit pieces (pigeonhole, so
nothing within the radius is lost). In a block the bit planes are stored vertically, 64
fingerprints to a machine word; carry-save counters add up many distances at once, and a
block is abandoned as soon as every distance exceeds the radius.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import LOWER, joined, lean, materialize, pick, slices, word_spans
from corpusmill.llm.components import connected_components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: A larger group of fingerprints that agree on a piece is cut in blocks that are joined in pairs.
BLOCK = 4096
#: Small groups are compared together until so many fingerprints are reached.
RUN = 1024


def shingle_hashes(data: np.ndarray, off: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each shingle of the lower-cased words, and the index of each document's first."""
    data = LOWER[data]
    s, e, firsts = word_spans(data, off)
    text, _, begin, end = joined(data, off, s, e, firsts)
    n = np.diff(firsts)
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    edges = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(n)), counts)
    first = firsts[:-1][doc] + np.arange(edges[-1]) - edges[doc]
    last = np.minimum(first + width, firsts[1:][doc]) - 1
    raw = memoryview(text.tobytes())
    digest = xxhash.xxh64_intdigest
    hashes = np.empty(len(first), np.uint64)
    step = 1 << 14
    for at in range(0, len(first), step):
        a, b = begin[first[at : at + step]].tolist(), end[last[at : at + step]].tolist()
        hashes[at : at + step] = [digest(raw[x:y], SEED) for x, y in zip(a, b)]
    return hashes, edges


def majority(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One uint64 for each run of hashes: a bit is set if it is set in over half of them; none: 0."""
    n = len(edges) - 1
    votes = np.zeros((n, 64), np.int64)
    step = 1 << 15
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lo, hi = np.searchsorted(edges, at, "right") - 1, np.searchsorted(edges, at + len(part), "left")
        starts = np.clip(edges[lo:hi] - at, 0, None)
        some = edges[lo + 1 : hi + 1] - at > starts
        votes[lo:hi][some] += np.add.reduceat(bits, starts[some], axis=0, dtype=np.int64)
    ones = votes * 2 > np.diff(edges)[:, None]
    return np.packbits(ones, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def fingerprints(data: np.ndarray, off: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each document; no words: 0."""
    return majority(*shingle_hashes(data, off, width))


def with_fingerprint(docs: DataFrame, column: str = "fp", width: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text) to (doc_id, fp bigint): the fingerprint's bits as a signed long."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in slices(batches):
            fp = fingerprints(data, off, width).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fp)], names=["doc_id", column])

    return pick(docs, "doc_id", "text").mapInArrow(lean(scan), f"doc_id bigint, {column} bigint")


def pieces_for(n: int, radius: int = RADIUS) -> int:
    """Pieces the 64 bits are cut in: more as n grows, which keeps the expected group of one key small. Exact for any value over radius."""
    m = radius + 1
    while m < radius + 5 and n > 1 << (64 * (m - radius) // m + 6):
        m += 1
    return m


def piece_masks(m: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of every choice of m - radius pieces: two fingerprints within the radius agree on one."""
    edges = [64 * i // m for i in range(m + 1)]
    pieces = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(m)]
    return [sum(c) for c in itertools.combinations(pieces, m - radius)]


def hits(fps: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Boolean (queries, fps): Hamming distance at most radius. Works on 64 fps to a word, plane by plane."""
    n = len(fps)
    lanes = (n + 63) // 64
    bits = np.zeros((64, lanes * 64), np.uint8)
    bits[:, :n] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    planes = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    flips = np.where(np.unpackbits(queries.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T, np.uint64(2**64 - 1), np.uint64(0))
    width = (radius + 1).bit_length()
    counters = [np.zeros((len(queries), lanes), np.uint64) for _ in range(width)]
    # the counters start so that they overflow just when the distance passes the radius
    start = (1 << width) - 1 - radius
    for k in range(width):
        if start >> k & 1:
            counters[k][:] = np.uint64(2**64 - 1)
    over = np.zeros((len(queries), lanes), np.uint64)
    if n % 64:
        over[:, -1] = np.uint64(2**64 - (1 << (n % 64)))
    for p in range(64):
        carry = planes[p][None, :] ^ flips[p][:, None]
        for k in range(width):
            carry, counters[k] = counters[k] & carry, counters[k] ^ carry
        over |= carry
        if p % 8 == 7 and np.all(over == np.uint64(2**64 - 1)):
            return np.zeros((len(queries), n), bool)
    return np.unpackbits((~over).astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)


def block_links(fps: np.ndarray, ids: np.ndarray, split: int = 0, radius: int = RADIUS, step: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all fingerprints within the radius, as stars. split: only pairs across that index (0: all pairs)."""
    n = len(fps)
    label = np.arange(n)
    others = slice(split, n)
    for at in range(0, split or n, step):
        found = hits(fps[others], fps[at : min(at + step, split or n)], radius)
        for i in np.flatnonzero(found.any(axis=1)):
            near = np.append(np.flatnonzero(found[i]) + split, at + i)
            labels = np.unique(label[near])
            if len(labels) > 1:
                label[np.isin(label, labels)] = labels[0]
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    root = least[label]
    linked = root != ids
    return ids[linked], root[linked]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, side, fp, rep) sorted by the key (k1, k2) and side to links (u, v)."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    held: list[np.ndarray] = []

    def flush(rows: np.ndarray, keyed: bool) -> Iterator[pa.RecordBatch]:
        side = rows[2]
        split = int((side == 0).sum()) if keyed and side.any() else 0
        u, v = block_links(rows[3].view(np.uint64), rows[4], split)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)

    rest = np.zeros((5, 0), np.int64)
    run: list[np.ndarray] = []
    size = 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            rows = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
        else:
            rows = rest
        cuts = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
        whole = np.split(rows, cuts, axis=1)
        if batch is not None:
            rest = whole.pop()
        for group in whole:
            if group.shape[1] < 2:
                continue
            if group[2].any():  # two blocks of one large group
                yield from flush(group, True)
                continue
            run.append(group)
            size += group.shape[1]
            if size >= RUN:
                yield from flush(np.concatenate(run, axis=1), False)
                run, size = [], 0
    if run:
        yield from flush(np.concatenate(run, axis=1), False)


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, n: int | None = None) -> DataFrame:
    """Links (u, v) over distinct(fp, rep) whose components are those of all pairs within the radius.

    Each fingerprint gets a key for every choice of pieces. Groups of one key larger than BLOCK
    are cut in blocks by a hash, and each pair of blocks is one task's work.
    """
    n = distinct.count() if n is None else n
    masks = piece_masks(pieces_for(n, radius), radius)
    keys = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("t"), F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))).alias("k")) for i, m in enumerate(masks)]))
    keyed = distinct.where("rep is not null").select("fp", "rep", keys.alias("x")).select("fp", "rep", F.col("x.k").alias("k1"))
    large = keyed.groupBy("k1").count().where(F.col("count") > BLOCK)
    rows = keyed.select("k1", F.lit(0).cast("bigint").alias("k2"), F.lit(0).cast("bigint").alias("side"), "fp", "rep")
    if large.limit(1).count():
        blocks = (F.col("count") / (BLOCK // 2)).cast("bigint") + 1
        sized = keyed.join(large, "k1", "left").withColumn("n", F.when(F.col("count").isNull(), 1).otherwise(blocks))
        own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("n"))
        sized = sized.withColumn("b", own).withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
        rows = sized.select("k1", (F.least("b", "o") * F.col("n") + F.greatest("b", "o")).alias("k2"), F.when(F.col("b") > F.col("o"), 1).otherwise(0).cast("bigint").alias("side"), "fp", "rep")
    sorted_rows = rows.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "side")
    return sorted_rows.mapInArrow(lean(_links), "u bigint, v bigint")


def simhash_components(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text).

    Empty and null texts have fingerprint zero and are linked like any other. Rows repeated
    under one doc_id each get a row. A null doc_id never names a component; if a component has
    no other, its component_id is null. No rows give no rows.
    """
    prints = materialize(with_fingerprint(docs, width=width))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = connected_components(fingerprint_links(distinct, radius))
    classes = distinct.join(roots, distinct.rep == roots.node, "left").select(
        F.col("fp").alias("class_fp"), F.coalesce("root", "rep").alias("component_id")
    )
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(classes, F.col("fp") == F.col("class_fp")).select("doc_id", hexed.alias("fingerprint"), "component_id")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from corpusmill.llm.common import table

    return simhash_components(table(spark, sf_dir, "documents"))
