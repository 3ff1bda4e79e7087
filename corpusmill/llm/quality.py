"""Quality classifier by co-training.

Two views of a document, its text content and its page metadata (source, language, length), have a
classifier each. Over several rounds each adds the documents of an unlabelled pool that it is most
sure of to the other's training set, with its own prediction as label. Both are then calibrated on
labelled documents that neither was trained on, and a logistic combination of the calibrated views scores
every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import pick, slices, span_hash, table, word_spans
from corpusmill.llm.langid import normal

#: Bounds of the labelled sample and of the unlabelled pool.
LABELLED, POOL = 6000, 6000
ROUNDS = 5
#: Documents of each class that a view passes on in a round, at most, and how sure it has to be.
PASSED, SURE = 100, 0.95
BUCKETS = 512
META = 128


def text_features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whole-text statistics and hashed byte-triple frequencies, one row per document."""
    n = len(off) - 1
    out = np.zeros((n, 16 + BUCKETS), np.float32)
    s, e, firsts = word_spans(data, off)
    hashes = span_hash(data, s, e)
    low = normal(data)
    kinds = np.zeros(256, np.int64)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".,;:!?'\"()-", b"%$#*&|@^~_=+<>[]{}\\/`"), 1):
        kinds[list(chars)] = k
    kinds[128:] = 8
    for i in range(n):
        a, b = off[i], off[i + 1]
        size = b - a
        if not size:
            continue
        out[i, :9] = np.bincount(kinds[data[a:b]], minlength=9) / size
        w = hashes[firsts[i] : firsts[i + 1]]
        lengths = (e - s)[firsts[i] : firsts[i + 1]]
        if len(w):
            _, counts = np.unique(w, return_counts=True)
            out[i, 9] = len(counts) / len(w)
            out[i, 10] = counts.max() / len(w)
            out[i, 11] = np.log1p(len(w)) / 10
            out[i, 12] = min(lengths.mean() / 20, 2)
            out[i, 13] = min(lengths.std() / 20, 2)
            out[i, 14] = (lengths <= 1).mean()
            out[i, 15] = (counts > 1).mean()
        d = low[a:b].astype(np.uint32)
        if len(d) >= 3:
            h = (d[:-2] * np.uint32(0x9E3779B1) ^ d[1:-1] * np.uint32(0x85EBCA77) ^ d[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(23)
            out[i, 16:] = np.sqrt(np.bincount(h, minlength=BUCKETS)[:BUCKETS] / len(h))
    return out


def meta_features(source: list[str | None], lang: list[str | None], n_chars: list[int | None]) -> np.ndarray:
    """Hashed source and language, and the magnitude of the length; nulls have values of their own."""
    out = np.zeros((len(source), META), np.float32)
    for i, (s, l, n) in enumerate(zip(source, lang, n_chars)):  # noqa: E741
        out[i, zlib.crc32(b"s" + repr(s).encode()) % 64] = 1
        out[i, 64 + zlib.crc32(b"l" + repr(l).encode()) % 32] = 1
        out[i, 96 + (31 if n is None else min(30, max(0, int(n)).bit_length()))] = 1
    return out


@dataclass
class Logistic:
    """Standardised logistic regression."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, steps: int = 12) -> Logistic:
    """Newton steps on the penalised likelihood."""
    weight = np.ones(len(y)) if weight is None else weight
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    scale = np.maximum(x.std(axis=0), 1e-3) if len(x) else np.ones(x.shape[1])
    z = np.concatenate([((x - mean) / scale).astype(np.float64), np.ones((len(x), 1))], axis=1)
    penalty = np.full(z.shape[1], l2)
    penalty[-1] = 1e-3
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ z + np.diag(penalty)
        w += np.linalg.solve(h, z.T @ (weight * (y - p)) - penalty * w)
    return Logistic(mean, scale, w[:-1], float(w[-1]))


def sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


@dataclass
class CoTrained:
    text: Logistic
    meta: Logistic
    text_line: Logistic  # calibration: margin to log-odds
    meta_line: Logistic
    both: Logistic

    def scores(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = (line.margin(view.margin(x)[:, None]) for view, line, x in ((self.text, self.text_line, t), (self.meta, self.meta_line, m)))
        return sigmoid(a), sigmoid(b), sigmoid(self.both.margin(np.stack([a, b], axis=1)))


def co_train(t: np.ndarray, m: np.ndarray, y: np.ndarray, pool_t: np.ndarray, pool_m: np.ndarray, rounds: int = ROUNDS) -> CoTrained:
    """t, m, y: views and labels of labelled documents; a fifth of them calibrates and takes no part in the rounds."""
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    own = {"t": (t[~held], y[~held], []), "m": (m[~held], y[~held], [])}
    pools = {"t": pool_t, "m": pool_m}
    taken = {"t": np.zeros(len(pool_t), bool), "m": np.zeros(len(pool_m), bool)}
    labels = {"t": np.zeros(len(pool_t)), "m": np.zeros(len(pool_m))}

    def fit(view: str) -> Logistic:
        x, target, _ = own[view]
        extra = taken[view]
        x, target = np.concatenate([x, pools[view][extra]]), np.concatenate([target, labels[view][extra]])
        # what the other view was sure of counts for less than a true label
        weight = np.concatenate([np.ones(len(own[view][1])), np.full(int(extra.sum()), 0.3)])
        return fit_logistic(x, target, weight)

    models = {v: fit(v) for v in "tm"}
    for _ in range(rounds):
        for view, other in (("t", "m"), ("m", "t")):
            p = sigmoid(models[view].margin(pools[view])) if len(pools[view]) else np.zeros(0)
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                order = np.argsort(-sure, kind="stable")
                chosen = order[(sure[order] >= SURE) & ~taken[other][order]][:PASSED]
                taken[other][chosen], labels[other][chosen] = True, label
        models = {v: fit(v) for v in "tm"}
    check = held if held.any() else np.ones(len(y), bool)
    lines = {v: fit_logistic(models[v].margin(x[check])[:, None], y[check], l2=0.1) for v, x in (("t", t), ("m", m))}
    a, b = (lines[v].margin(models[v].margin(x[check])[:, None]) for v, x in (("t", t), ("m", m)))
    return CoTrained(models["t"], models["m"], lines["t"], lines["m"], fit_logistic(np.stack([a, b], axis=1), y[check], l2=0.1))


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, h, text, source, lang, n_chars) to (y, h, t, m): features as float32 bytes."""
    for rows, data, off in slices(batches, limit=1 << 20):
        t, m = text_features(data, off), meta_features(*(rows.column(i).to_pylist() for i in (3, 4, 5)))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([x.tobytes() for x in t], pa.binary()), pa.array([x.tobytes() for x in m], pa.binary())], names=["y", "h", "t", "m"])


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, width)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> CoTrained | None:
    """Train on up to `labelled` documents of labels(doc_id, quality) and up to about `pool` others, chosen by a hash.

    Labels other than 0 and 1 and documents with contradicting labels are left out; None if no label is left.
    """
    clean = pick(labels, "doc_id", "quality").where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("hi")).where("y = hi")
    chosen = clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).select("doc_id", "y")
    base = pick(docs, "doc_id", "text", "source", "lang", "n_chars")
    n = base.count()
    h = F.xxhash64("doc_id")
    columns = ["h", "text", "source", "lang", "n_chars"]
    known = base.join(F.broadcast(chosen), "doc_id").select(F.col("y").cast("double").alias("y"), h.alias("h"), *columns[1:])  # at most `labelled` ids
    got = known.mapInArrow(_views, "y double, h bigint, t binary, m binary").limit(2 * labelled).toArrow()
    if not got.num_rows:
        return None
    scale = 1 << 40
    some = base.withColumn("h", h).where(F.pmod("h", F.lit(scale)) < int(scale * min(1.0, pool / max(1, n))))
    some = some.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
    rest = some.select(F.lit(None).cast("double").alias("y"), *columns).mapInArrow(_views, "y double, h bigint, t binary, m binary").limit(2 * pool).toArrow()
    got, rest = got.sort_by([("h", "ascending"), ("y", "ascending")]), rest.sort_by("h")
    width = 16 + BUCKETS
    return co_train(_matrix(got["t"], width), _matrix(got["m"], META), np.array(got["y"]), _matrix(rest["t"], width), _matrix(rest["m"], META))


def score(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """(doc_id, text_score, meta_score, score, quality) for every row of docs(doc_id, text, source, lang, n_chars).

    Scores are probabilities of good quality; quality is 1 where the combined score is at least one half.
    Null texts are read as empty, null metadata as a value of its own. Without a model all scores are 0.5
    and quality is 1. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in slices(batches, limit=1 << 20):
            m = shared.value
            if m is None:
                found = [np.full(rows.num_rows, 0.5)] * 3
            else:
                found = m.scores(text_features(data, off), meta_features(*(rows.column(i).to_pylist() for i in (2, 3, 4))))
            yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(x.astype(float)) for x in found], pa.array((found[2] >= 0.5).astype(np.int32))], names=["doc_id", "text_score", "meta_score", "score", "quality"])

    return pick(docs, "doc_id", "text", "source", "lang", "n_chars").mapInArrow(scan, "doc_id bigint, text_score double, meta_score double, score double, quality int")


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
