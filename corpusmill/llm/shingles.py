"""SimHash near-dedup with an exact limit on the similarity of word shingles.

Two documents are near duplicates if the Jaccard similarity of their sets of 5-word shingles is at
least 0.8. The 64-bit fingerprints of such sets differ in 10 bits on average, so a small radius would lose
many and a large one finds others too. Here a wide radius only selects: documents meet in blocks of those that share a key of
three least shingles out of several, a block's fingerprints are compared bit-sliced, parities of the
sets (odd sketches, which differ in no more places than the sets do) discard most of what is left, and the
rest is compared shingle by shingle.

A pair of similarity 0.8 misses all keys with a probability of (1 - 0.8**3)**20, less than one in a million, and lies
outside the radius less often still; more similar pairs are lost by far less.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import lean, materialize, mix, pick, release, slices
from corpusmill.llm.components import connected_components
from corpusmill.llm.simhash import SEED, hits, majority, shingle_hashes

WIDTH = 5
#: Least similarity, as a fraction.
PART, WHOLE = 4, 5
#: Keys of a document, and least shingles in each.
BANDS, ROWS = 20, 3
#: Fingerprints that differ in more bits are not compared further; sets under SMALL shingles are, as theirs vary more.
RADIUS, SMALL = 24, 16
#: Bits of a sketch at most; a smaller one tells long sets apart less well, and loses nothing.
SKETCH = 1 << 10
#: A larger block is cut in parts that are joined in pairs.
BLOCK = 1024
#: Small blocks are compared together until so many sets are reached.
RUN = 256

_FACTORS = np.random.default_rng(5).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(shingles: np.ndarray) -> bytes:
    """Parity of the shingles by their low bits; one bit a shingle, within 64 and SKETCH bits."""
    m = min(SKETCH, 1 << max(6, (len(shingles) - 1).bit_length()))
    return np.packbits(np.bincount(shingles & np.uint64(m - 1), minlength=m) & 1, bitorder="little").tobytes()


def keys_of(shingles: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(documents, BANDS): each key hashes the least of the shingles in ROWS orders. No document is empty."""
    out = np.empty((len(edges) - 1, BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(edges) - 1, b + 1, np.uint64)
        for f in _FACTORS[b * ROWS : (b + 1) * ROWS]:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(shingles * f, edges[:-1]))
        out[:, b] = key
    return out


def own_shingles(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The sorted set of shingles of each document."""
    hashes, edges = shingle_hashes(data, off, WIDTH)
    return [np.unique(hashes[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def node_of(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def sets_of(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, node, n, fp, keys, sketch) of docs(doc_id, text); mark is a hash of the text, node stands for the set. From n on all are null where the task has had the set, or it is empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rows, data, off in slices(batches):
            sets = own_shingles(data, off)
            nodes = [node_of(s) for s in sets]
            fresh = []
            for i, node in enumerate(nodes):
                if len(sets[i]) and node not in seen:
                    seen.add(node)
                    fresh.append(i)
            more: list[list] = [[None] * len(sets) for _ in range(4)]
            if fresh:
                edges = np.concatenate([[0], np.cumsum([len(sets[i]) for i in fresh])]).astype(np.int64)
                together = np.concatenate([sets[i] for i in fresh])
                fps, keys = majority(together, edges).view(np.int64).tolist(), keys_of(together, edges).view(np.int64)
                for k, i in enumerate(fresh):
                    for column, v in zip(more, (len(sets[i]), fps[k], keys[k], sketch(sets[i]))):
                        column[i] = v
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), rows.column(2), *(pa.array(c, f.type) for c, f in zip([nodes, *more], list(schema)[2:]))], schema=schema)

    source = pick(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("mark"))
    return source.mapInArrow(lean(scan), "doc_id bigint, mark bigint, node bigint, n bigint, fp bigint, keys array<bigint>, sketch binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.Table]]:
    """Rows sorted by their first columns, as lists of whole groups."""
    rest: pa.Table | None = None
    for batch in itertools.chain(batches, [None]):
        if batch is None:
            if rest is not None and rest.num_rows:
                yield [rest]
            return
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
        change = np.zeros(max(0, rows.num_rows - 1), bool)
        for c in range(keys):
            change |= np.diff(rows.column(c).to_numpy()) != 0
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1]).tolist()
        yield [rows.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]
        rest = rows.slice(cuts[-1])


def _parities(i: np.ndarray, j: np.ndarray, sketches: list[bytes]) -> np.ndarray:
    """In how many places the sketches of each pair differ at least; a longer one is folded to the shorter's length."""
    out = np.zeros(len(i), np.int64)
    sizes = np.array([len(s) for s in sketches])
    shape = sizes[i] * (1 << 32) + sizes[j]
    for key in np.unique(shape).tolist():
        a, b = key >> 32, key & (1 << 32) - 1
        which = np.flatnonzero(shape == key)
        step = max(1, (1 << 22) // max(a, b))
        for at in range(0, len(which), step):
            part = which[at : at + step]
            x, y = (np.frombuffer(b"".join(sketches[k] for k in side[part].tolist()), np.uint64).reshape(len(part), -1) for side in (i, j))
            while x.shape[1] > y.shape[1]:
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            while y.shape[1] > x.shape[1]:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            out[part] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def close_pairs(n: np.ndarray, sketches: list[bytes], label: np.ndarray, side: np.ndarray, fps: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that fingerprints, sizes and sketches allow to be similar, with different labels; across sides where there are two."""
    first, second = [], []
    small = n < SMALL
    for at in range(0, len(n), 128):
        a = np.arange(at, min(at + 128, len(n)))
        near = np.arange(len(n)) > a[:, None]
        if fps is not None:
            near &= hits(fps, fps[a], RADIUS) | (small | small[a][:, None])
        near &= WHOLE * np.minimum(n[a][:, None], n) >= PART * np.maximum(n[a][:, None], n)
        near &= label[a][:, None] != label
        if side.any():
            near &= side[a][:, None] != side
        i, j = np.nonzero(near)
        i = a[i]
        ok = _parities(i, j, sketches) * (PART + WHOLE) <= (n[i] + n[j]) * (WHOLE - PART)
        first.append(i[ok])
        second.append(j[ok])
    return np.concatenate(first), np.concatenate(second)


def _candidates(every: bool):
    """Rows (s, k2, side, node, n, fp, label, sketch) to pairs (a, b): all close pairs, or each node's with the neighbour of most neighbours."""

    def compare(rows: pa.Table, sided: bool) -> pa.RecordBatch:
        node, at = np.unique(rows.column("node").to_numpy(), return_index=True)
        n, fp, label, side = (rows.column(c).to_numpy()[at] for c in ("n", "fp", "label", "side"))
        sketches = rows.column("sketch").take(pa.array(at)).to_pylist()
        a, b = close_pairs(n, sketches, label, side if sided else np.zeros(len(at), np.int64), fp.view(np.uint64))
        if not every and len(a):
            degree = np.bincount(np.concatenate([a, b]), minlength=len(at))
            rank = np.empty(len(at), np.int64)
            rank[np.lexsort((-np.arange(len(at)), degree))] = np.arange(len(at))
            best = np.full(len(at), -1)
            np.maximum.at(best, a, rank[b])
            np.maximum.at(best, b, rank[a])
            by_rank = np.argsort(rank)
            a = np.flatnonzero(best >= 0)
            b = by_rank[best[a]]
        u, v = node[a], node[b]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["a", "b"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[pa.Table] = []
        for groups in _groups(batches, 2):
            for g in groups:
                side = g.column("side").to_numpy()
                if side.any():
                    if not side.all():
                        yield compare(g, True)
                    continue
                if g.num_rows < 2:
                    continue
                run.append(g)
                if sum(r.num_rows for r in run) >= RUN:
                    yield compare(pa.concat_tables(run).combine_chunks(), False)
                    run = []
        if run:
            yield compare(pa.concat_tables(run).combine_chunks(), False)

    return lean(scan)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both * (PART + WHOLE) >= PART * (len(x) + len(y)))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])


def _rehash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (node, shingles)."""
    for _, data, off in slices(batches):
        sets = own_shingles(data, off)
        yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets, roots): sets_of() the documents, written, and (node, root) of the nodes that are similar to another."""
    docs = pick(docs, "doc_id", "text")
    sets = materialize(sets_of(docs))
    whole = sets.where("n is not null")
    entries = whole.select(F.explode("keys").alias("s"), "node", "n", "fp", "sketch")
    sizes = entries.groupBy("s").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("s", "size")
    shared = materialize(entries.join(sizes, "s"))
    parts = F.when(F.col("size") > BLOCK, (F.col("size") / (BLOCK // 2)).cast("bigint") + 1).otherwise(F.lit(1).cast("bigint"))

    def links(rows: DataFrame, every: bool) -> DataFrame:
        cut = rows.withColumn("m", parts).withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("m"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)))
        cut = cut.select("s", (F.least("own", "other") * F.col("m") + F.greatest("own", "other")).alias("k2"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).cast("bigint").alias("side"), "node", "n", "fp", "label", "sketch")
        pairs = materialize(cut.repartition("s", "k2").sortWithinPartitions("s", "k2", "side").mapInArrow(_candidates(every), "a bigint, b bigint").distinct())
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        # one document for each set that has to be read again
        one = sets.groupBy("node").agg(F.min(F.struct("mark", "doc_id")).alias("x"))  # of copies only one is joined
        named = one.join(wanted, "node").select(F.col("x.doc_id").alias("named_id"), F.col("x.mark").alias("mark")).distinct()
        texts = docs.join(named, docs.doc_id.eqNullSafe(named.named_id) & (F.xxhash64(docs.text) == named.mark), "left_semi").select("text")
        own = materialize(texts.mapInArrow(lean(_rehash), "node bigint, shingles binary").dropDuplicates(["node"]))
        both = pairs.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b").select("a", "b", "x", "y")
        found = materialize(both.mapInArrow(_similar, "u bigint, v bigint"))
        release(pairs)
        release(own)
        return found

    # most sets of a block are linked through one that they share; then what is still apart is compared pair by pair
    found = links(shared.withColumn("label", F.col("node")), False)
    roots = connected_components(found)
    labelled = shared.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    apart = labelled.groupBy("s").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("s")
    rest = labelled.join(apart, "s", "left_semi")
    return sets, connected_components(found.union(links(rest, True)))


def similar_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, root) for every row of docs(doc_id, text): one root for each component of similar documents; mark is xxhash64(text).

    Texts without words are one group. Texts of fewer words than a shingle are one shingle. No rows give no rows.
    """
    sets, roots = _linked(docs)
    return sets.select("doc_id", "mark", "node").join(roots, "node", "left").select("doc_id", "mark", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs(doc_id, text, ...) for each group of similar documents: that of the smallest doc_id.

    A row without doc_id is kept only where no row of its group has one; of rows that repeat doc_id and text one stays.
    Copies are put together before anything is joined, so that a frequent text is no hot key.
    """
    sets, roots = _linked(docs)
    least = sets.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("x"))
    groups = least.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("x").alias("x"))
    kept = groups.select(F.col("x.doc_id").alias("kept_id"), F.col("x.mark").alias("kept_mark")).distinct()
    times = sets.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    kept = materialize(kept)
    text = docs[next(c for c in docs.columns if c == "text")] if docs.columns.count("text") == 1 else F.col("text")
    out = docs.join(kept, docs["doc_id"].eqNullSafe(kept.kept_id) & (F.xxhash64(text) == kept.kept_mark), "left_semi")
    again = materialize(times.select(F.col("doc_id").alias("again_id"), F.col("mark").alias("again_mark")))
    if not again.limit(1).count():
        return out
    match = out["doc_id"].eqNullSafe(again.again_id) & (F.xxhash64(out["text"]) == again.again_mark)
    return out.join(again, match, "left_anti").unionByName(out.join(again, match, "left_semi").dropDuplicates(["doc_id", "text"]))
