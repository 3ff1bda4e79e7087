"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are rotated to their leading principal dimensions and put in grid cells of side epsilon,
the distance that corresponds to the cosine limit. Vectors are sorted by cell (epsilon grid
order) and cut into intervals with bounding boxes. Pairs of intervals are joined recursively: a pair of nodes
of the interval tree is opened into its children only if their boxes lie within epsilon, so
provably distant blocks are never compared. At the leaves cosines are computed in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize, pick, table
from corpusmill.llm.components import connected_components

COSINE = 0.93
#: Principal dimensions of the grid.
DIMS = 8
#: Vectors in an interval at most.
INTERVAL = 1024
#: Children of a tree node, as a power of two.
FANOUT_BITS = 4
#: Bound of the sample that the principal dimensions are fitted on; any rotation keeps the join exact.
SAMPLE = 4096

_BOX = [f"{e}{d}" for e in ("lo", "hi") for d in range(DIMS)]


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, embedding) to (vec_id, label, dim, raw): raw are the doubles, null if the vector links with nothing."""
    for rows in batches:
        ids, labels, vectors = rows.columns
        dims, raws = [], []
        values = vectors.flatten()
        sizes = np.diff(np.array(vectors.offsets)) if not vectors.null_count else np.array([len(v) if v.is_valid else 0 for v in vectors])
        numbers = np.array(values.fill_null(math.nan), dtype=float)
        at = 0
        for i, size in enumerate(sizes.tolist()):
            x = numbers[at : at + size]
            at += size
            top = np.abs(x).max() if size else 0.0
            ok = ids[i].is_valid and labels[i].is_valid and np.isfinite(x).all() and top > 0
            dims.append(size)
            raws.append((x + 0.0).astype("<f8").tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays([ids, labels, pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], names=["vec_id", "label", "dim", "raw"])


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by the largest component first, so that no square over- or underflows."""
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def rotations(sample: list[tuple[int, bytes]]) -> dict[int, np.ndarray]:
    """By dimension: orthonormal columns, the leading principal directions first."""
    out = {}
    for dim in {d for d, _ in sample}:
        x = unit(np.frombuffer(b"".join(r for d, r in sample if d == dim), "<f8").reshape(-1, dim))
        _, vectors = np.linalg.eigh(np.cov(x.T, ddof=0).reshape(dim, dim))
        out[dim] = vectors[:, ::-1][:, :DIMS]
    return out


def project(x: np.ndarray, rotation: np.ndarray | None) -> np.ndarray:
    """Coordinates in the leading dimensions; zeros stand for dimensions that there aren't."""
    p = x @ rotation if rotation is not None else x[:, :DIMS]
    return np.pad(p, ((0, 0), (0, DIMS - p.shape[1])))


def linked(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Boolean (rows of a, rows of b): cosine at least the limit; close calls are computed again in the plain way."""
    c = unit(a) @ unit(b).T
    out = c >= cosine
    for i, j in zip(*np.nonzero(np.abs(c - cosine) < 1e-9)):
        x, y = a[i] / np.abs(a[i]).max(), b[j] / np.abs(b[j]).max()
        out[i, j] = math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y)) >= cosine
    return out


def forest(mask: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars around the least ids that join what a bipartite link matrix joins."""
    rows, cols = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    m = mask[np.ix_(rows, cols)]
    la, lb = ia[rows].copy(), ib[cols].copy()
    most = np.iinfo(np.int64).max
    while len(rows):
        nb = np.minimum(lb, np.where(m, la[:, None], most).min(axis=0))
        na = np.minimum(la, np.where(m, nb[None, :], most).min(axis=1))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    u, v = np.concatenate([ia[rows], ib[cols]]), np.concatenate([la, lb])
    return u[u != v], v[u != v]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, interval: int = INTERVAL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, label).

    Vectors of equal label and dimension link if their cosine is at least the limit. Null, empty and zero
    vectors, those with null or non-finite components, and rows with a null label or vec_id link with nothing:
    they have no links and are a component of their own. Equal vectors are compared once and
    counted as often as they occur. Rows that share a vec_id are one vector to the links. No rows give no rows.
    """
    eps = math.sqrt(2 - 2 * cosine)
    source = pick(vectors, "vec_id", "label", "embedding").select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = source.mapInArrow(_valid, "vec_id bigint, label string, dim int, raw binary")
    rows = materialize(rows.withColumn("k1", F.xxhash64("label", "raw")).withColumn("k2", F.md5(F.concat(F.col("label").cast("binary"), F.lit(b"\0"), "raw"))))
    key = ["label", "dim", "k1", "k2"]
    classes = rows.where("raw is not null").groupBy(key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("raw").alias("raw"))
    classes = materialize(classes)
    sample = classes.orderBy("k1", "k2").limit(SAMPLE).select("dim", "raw").collect()
    shared = vectors.sparkSession.sparkContext.broadcast(rotations([(r["dim"], bytes(r["raw"])) for r in sample]))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column(1))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = unit(np.frombuffer(b"".join(part.column(4).to_pylist()), "<f8").reshape(-1, dim))
                p = project(x, shared.value.get(int(dim)))
                cell = pa.array(list(np.floor(p / eps).astype(np.int32)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(p), pa.list_(pa.float64())), cell], names=["label", "dim", "rep", "copies", "raw", "p", "cell"])

    ddl = "label string, dim int, rep bigint, copies bigint, raw binary, p array<double>, cell array<int>"
    gridded = classes.select("label", "dim", "rep", "copies", "raw").mapInArrow(cells, ddl)
    order = ["label", "dim", "cell", "rep"]
    parts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = gridded.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    blocks = materialize(ordered.mapInArrow(lambda b: _intervals(b, interval), "label string, dim int, part int, seq bigint, ids binary, copies binary, raws binary, " + ", ".join(f"{c} double" for c in _BOX)))

    number = F.row_number().over(Window.partitionBy("label", "dim").orderBy("part", "seq")) - 1
    boxes = materialize(blocks.select("label", "dim", "part", "seq", *_BOX, number.cast("bigint").alias("node")))
    most = boxes.agg(F.coalesce(F.max("node"), F.lit(0))).first()[0]
    levels = 0
    while most >> (FANOUT_BITS * levels):
        levels += 1
    pairs = boxes.select("label", "dim", F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")).distinct()
    for level in range(levels - 1, -1, -1):
        pairs = _open(pairs, boxes, level, eps)
    payload = blocks.join(boxes.select("label", "dim", "part", "seq", "node"), ["label", "dim", "part", "seq"]).select("label", "dim", "node", "ids", "copies", "raws")
    payload = materialize(payload, compression="none")
    named = lambda s: payload.select("label", "dim", F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "copies", "raws")])
    leaves = pairs.join(named("a"), ["label", "dim", "a"]).join(named("b"), ["label", "dim", "b"])
    columns = ["dim", "a", "b", "ids_a", "copies_a", "raws_a", "ids_b", "copies_b", "raws_b"]
    found = materialize(leaves.select(*columns).mapInArrow(lambda b: _join(b, cosine), "kind int, u bigint, v bigint"))

    roots = connected_components(found.where("kind = 1").select("u", "v"))
    counts = found.where("kind = 0").groupBy(F.col("u").alias("rep")).agg(F.sum("v").alias("links"))
    info = classes.select(*[F.col(k).alias(f"c_{k}") for k in key], "rep", "copies").join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    match = (rows.k1 == info.c_k1) & (rows.k2 == info.c_k2) & (rows.label == info.c_label) & (rows.dim == info.c_dim) & rows.raw.isNotNull()
    out = rows.join(info, match, "left")
    n_links = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
    component = F.coalesce("root", "rep", "vec_id")
    return out.select("vec_id", n_links.cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _intervals(batches: Iterator[pa.RecordBatch], interval: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows to intervals of one label and dimension, with their vectors and boxes."""
    held: list[dict] = []
    seq = 0

    def out() -> pa.RecordBatch:
        p = np.array([r["p"] for r in held])
        box = np.concatenate([p.min(axis=0), p.max(axis=0)])
        first = held[0]
        values = [first["label"], first["dim"], first["part"], seq, np.array([r["rep"] for r in held], "<i8").tobytes(), np.array([r["copies"] for r in held], "<i8").tobytes(), b"".join(r["raw"] for r in held), *box.tolist()]
        types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()] + [pa.float64()] * (2 * DIMS)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["label", "dim", "part", "seq", "ids", "copies", "raws", *_BOX])

    for batch in batches:
        for row in batch.select(["label", "dim", "rep", "copies", "raw", "p", "part"]).to_pylist():
            if held and (len(held) == interval or (held[0]["label"], held[0]["dim"]) != (row["label"], row["dim"])):
                yield out()
                held, seq = [], seq + 1
            held.append(row)
    if held:
        yield out()


def _open(pairs: DataFrame, boxes: DataFrame, level: int, eps: float) -> DataFrame:
    """Pairs of nodes to the pairs of their children whose boxes lie within eps."""
    shift = FANOUT_BITS * level
    node = F.shiftright("node", shift)
    nodes = boxes.groupBy("label", "dim", node.alias("n")).agg(*[(F.min if c[0] == "l" else F.max)(c).alias(c) for c in _BOX])
    side = lambda s: nodes.select("label", "dim", F.shiftright("n", FANOUT_BITS).alias(s), F.col("n").alias(f"n_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in _BOX])
    opened = pairs.join(side("a"), ["label", "dim", "a"]).join(side("b"), ["label", "dim", "b"])
    gaps = [F.greatest(F.lit(0.0), F.col(f"lo{d}_a") - F.col(f"hi{d}_b"), F.col(f"lo{d}_b") - F.col(f"hi{d}_a")) for d in range(DIMS)]
    distance = sum((g * g for g in gaps), F.lit(0.0))
    near = opened.where(F.col("n_a") <= F.col("n_b")).where(distance <= eps * eps * (1 + 1e-6) + 1e-9)
    return near.select("label", "dim", F.col("n_a").alias("a"), F.col("n_b").alias("b"))


def _join(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Pairs of intervals to link counts (0, id, links) and to links that join the same components (1, id, id)."""
    schema = pa.schema([("kind", pa.int32()), ("u", pa.int64()), ("v", pa.int64())])
    for batch in batches:
        for row in batch.to_pylist():
            ia, ib, ca, cb = (np.frombuffer(row[c], "<i8") for c in ("ids_a", "ids_b", "copies_a", "copies_b"))
            a, b = (np.frombuffer(row[c], "<f8").reshape(-1, row["dim"]) for c in ("raws_a", "raws_b"))
            mask = linked(a, b, cosine)
            same = row["a"] == row["b"]
            if same:
                np.fill_diagonal(mask, False)
            if not mask.any():
                continue
            u, n = (ia, mask @ cb) if same else (np.concatenate([ia, ib]), np.concatenate([mask @ cb, ca @ mask]))
            eu, ev = forest(mask, ia, ib)
            kind = np.concatenate([np.zeros(int((n > 0).sum()), np.int32), np.ones(len(eu), np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([u[n > 0], eu])), pa.array(np.concatenate([n[n > 0], ev]))], schema=schema)


def op3_embeddings(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
