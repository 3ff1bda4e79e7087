"""Language identification: averaged hashed subword embeddings with a linear softmax.

Every run of one to four bytes of the lower-cased text is a subword that hashes to an embedding; their
average goes through a linear layer and a softmax. Embeddings and weights are learned together by
stochastic gradient descent in numpy on a bounded sample of labelled documents; the temperature
and the rejection threshold are set on a part of that sample that the training does not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import LOWER, SEPARATOR, lean, pick, slices, table

UNKNOWN = "und"
#: Bound of the training sample: documents for each language, and in all; with more languages there are fewer of each, and one at least.
PER_LANGUAGE = 400
SAMPLE = 4000
BUCKETS = 1 << 14
ORDERS = (1, 2, 3, 4)
_LETTER = regex.compile(r"\p{L}")
#: Share of correctly predicted documents of the calibration part that may be rejected.
REJECT_SHARE = 0.001


def subwords(data: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the run of order bytes that starts at each byte of data, except the last order - 1."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    h = np.full(n, 0x811C9DC5 + order, np.uint32)
    for k in range(order):
        h ^= data[k : n + k]
        h *= np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return (h >> np.uint32(32 - BUCKETS.bit_length() + 1)).view(np.int32)


def normal(data: np.ndarray) -> np.ndarray:
    """Lower case, and one kind of white space."""
    data = LOWER[data]
    data[SEPARATOR[data]] = 0x20
    return data


def document_sums(data: np.ndarray, off: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document the sum over its subwords of values[bucket], and the number of subwords."""
    data = normal(data)
    n = len(off) - 1
    total, count = np.zeros((n, values.shape[1])), np.zeros(n, np.int64)
    for order in ORDERS:
        ids = subwords(data, order)
        counts = np.maximum(np.diff(off) - order + 1, 0)
        some = np.flatnonzero(counts)
        if len(some):
            starts = off[:-1][some]
            for j in range(values.shape[1]):
                # runs that cross a document's end stand between its last own run and the next document: they are cut off
                edges = np.stack([starts, starts + counts[some]], axis=1).reshape(-1)
                # summed document by document, so that a score doesn't depend on what else is in the batch
                total[some, j] += np.add.reduceat(np.append(values[:, j][ids], 0.0), edges)[0::2]
        count += counts
    return total, count


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # (buckets, languages): embedding times linear layer
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        total, count = document_sums(data, off, self.logits)
        z = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train(features: np.ndarray, target: np.ndarray, languages: list[str], dim: int = 16, epochs: int = 20, rate: float = 1.0, seed: int = 1) -> Model:
    """features: (documents, buckets) subword frequencies, each row summing to one."""
    rng = np.random.default_rng(seed)
    n, k = len(features), len(languages)
    order = rng.permutation(n)
    held = order[: n // 5] if n >= 5 * k else order[:0]
    rest = order[len(held) :]
    scale = np.float32(1 / max(1e-9, np.sqrt(np.einsum("ij,ij->i", features, features).mean())))
    emb = (rng.standard_normal((features.shape[1], dim)) / np.sqrt(dim)).astype(np.float32)
    lin = np.zeros((dim, k), np.float32)
    bias = np.zeros(k, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(rest), max(1, len(rest) // 48)):
            x = features[batch]
            hidden = scale * (x @ emb)
            g = softmax(hidden @ lin + bias)
            g[np.arange(len(batch)), target[batch]] -= 1
            g /= len(batch)
            back = g @ lin.T
            lin -= step * (hidden.T @ g)
            bias -= step * g.sum(axis=0)
            emb -= step * scale * (x.T @ back)
    logits = (scale * (emb @ lin)).astype(np.float64)
    if not len(held):
        return Model(languages, logits, bias.astype(np.float64), 1.0, 0.0)
    z = features[held] @ logits + bias
    # smoothed labels: a calibration part without errors doesn't prove that there are none
    wish = np.full((len(held), k), 0.01 / k)
    wish[np.arange(len(held)), target[held]] += 0.99
    grid = np.geomspace(0.05, 20, 60)
    temperature = float(min(grid, key=lambda t: -(wish * np.log(np.maximum(softmax(z / t), 1e-12))).sum()))
    p = softmax(z / temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == target[held]])
    # below half the least confidence that a right prediction had, at the rejected share; never above an even chance
    threshold = min(float(right[int(REJECT_SHARE * len(right))]) / 2, 0.5) if len(right) else 0.0
    return Model(languages, logits, bias.astype(np.float64), temperature, threshold)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents whose CRC32 of doc_id as text leaves 2 modulo 4: never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 1) -> Model | None:
    """Learn from docs(doc_id, text, lang) that aren't held out and have a lang; None if there are none.

    Every lang value is learned. The sample has up to about per_language documents of each, and SAMPLE of all, chosen by a
    hash of doc_id (rows without one are in it together or not at all); documents that tie in it are ordered by lang.
    """
    known = pick(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    per_language = max(1, min(per_language, SAMPLE // len(counts)))
    languages = sorted(counts)
    scale = 1 << 40
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(scale, int(scale * per_language / n)))])
    sample = known.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(scale))).where(F.col("h") < F.element_at(share, F.col("lang")))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in slices(batches):
            ids, shares = [], []
            for a, b in zip(off[:-1], off[1:]):
                d = normal(data[a:b])
                count = np.bincount(np.concatenate([subwords(d, k) for k in ORDERS]), minlength=BUCKETS)
                some = np.flatnonzero(count)
                ids.append(some.astype("<u2").tobytes())
                shares.append((count[some] / max(1, count.sum())).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], names=["h", "lang", "ids", "shares"])

    bound = per_language * len(languages) * 2 + 100
    got = sample.select("text", "h", "lang").mapInArrow(lean(features), "h bigint, lang string, ids binary, shares binary").limit(bound).toArrow()
    names = np.array([languages.index(v) for v in got.column("lang").to_pylist()], np.int64)
    order = np.lexsort((names, np.array(got.column("h"))))
    x = np.zeros((len(order), BUCKETS), np.float32)
    for row, i in enumerate(order.tolist()):
        x[row, np.frombuffer(got.column("ids")[i].as_buffer(), "<u2")] = np.frombuffer(got.column("shares")[i].as_buffer(), "<f4")
    del got
    return train(x, names[order], languages, seed=seed)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(text, ...) with lang_pred, score (0 to 1) and rejected added to all columns.

    lang_pred is und, with score 0 and rejected, for null texts, texts without a letter and
    without a model; else the likeliest language, rejected where its calibrated probability is
    below the model's threshold. Columns of docs named like these three are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "rejected") and (c == "text" or c.lower() != "text")]
    source = pick(docs, *names)
    out_type = T.StructType([*source.schema.fields, *T.StructType.fromDDL("lang_pred string, score double, rejected boolean").fields])
    schema = to_arrow_schema(out_type)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rows, data, off in slices(batches, limit=1 << 20):
            texts = rows.column(rows.schema.get_field_index("text")).to_pylist()
            letter = np.array([bool(t) and _LETTER.search(t) is not None for t in texts])
            if m is None:
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
                letter[:] = False
            else:
                p = m.probabilities(data, off)
                best, score = p.argmax(axis=1), np.where(letter, p.max(axis=1), 0.0)
            langs = [m.languages[b] if ok else UNKNOWN for b, ok in zip(best, letter)]
            rejected = ~letter | (score < (m.threshold if m else 0))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], schema=schema)

    return source.mapInArrow(lean(scan), out_type)


def op10_langid(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
