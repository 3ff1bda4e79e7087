from __future__ import annotations

import math

import numpy as np
import pytest

from corpusmill.llm import embeddings as em
from tests.llm import helpers


def brute_force(rows: list[tuple]) -> dict[int, tuple[int, int, bool]]:
    """rows(vec_id, embedding, label) to vec_id: (n_links, component_id, kept)."""
    good = {i: np.array(v, float) for i, v, label in rows if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    labels = {i: label for i, _, label in rows}
    links = []
    for a in good:
        for b in good:
            if a < b and labels[a] == labels[b] and len(good[a]) == len(good[b]):
                x, y = good[a], good[b]
                if math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y)) >= em.COSINE:
                    links.append((a, b))
    group = helpers.components([i for i, _, _ in rows], links)
    return {i: (sum(i in e for e in links), group[i], group[i] == i) for i, _, _ in rows}


def result(df) -> dict:
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def planted(seed: int, n: int = 260, dim: int = 24) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(8)] + rng.standard_normal(dim) * rng.choice([0.05, 0.2, 0.5])
        if i % 10 == 0 and rows:
            v = np.array(rows[rng.integers(len(rows))][1])
        rows.append((i, (v * rng.choice([1, 3])).astype(np.float32).astype(float).tolist(), int(rng.integers(3)) if i % 17 else None))
    odd = [([0.0] * dim, 1), ([math.nan] * dim, 1), ([math.inf] + [1.0] * (dim - 1), 1), ([None] + [1.0] * (dim - 1), 1), (None, 1), ([], 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1), ([1.0] * dim, None)]
    return rows + [(1000 + k, v, label) for k, (v, label) in enumerate(odd)]


@pytest.mark.parametrize("interval", [1024, 7])
def test_equals_brute_force(spark, interval):
    rows = planted(1)
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    assert result(em.near_duplicates(frame, interval=interval)) == brute_force(rows)


def test_query_equals_brute_force(spark, small):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert result(em.op3_embeddings(spark, small)) == brute_force(rows)


def test_cosines_at_the_limit():
    a = np.array([[1.0, 0.0]])
    c = em.COSINE
    on = np.array([[c, math.sqrt(1 - c * c)]])
    below = np.array([[c - 1e-12, math.sqrt(1 - (c - 1e-12) ** 2)]])
    exact = lambda b: float(b[0, 0]) / math.sqrt(float(b[0, 0]) ** 2 + float(b[0, 1]) ** 2) >= c
    assert em.linked(a, on, c)[0, 0] == exact(on)
    assert not em.linked(a, below, c)[0, 0]
    assert em.linked(a * 1e-200, on * 1e200, c)[0, 0] == exact(on)


def test_copies_and_repeated_ids(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -2.0, 1.0]
    rows = [(5, v, 1), (6, v, 1), (7, v, 1), (8, v, 2), (9, w, 1), (9, w, 1), (None, v, 1)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").selectExpr("*", "7 AS Label")
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in em.near_duplicates(frame).collect()), key=str)
    assert [g for g in got if g[0] in (5, 6, 7)] == [(5, 2, 5), (6, 2, 5), (7, 2, 5)]
    assert (8, 0, 8) in got and (0, 0, None) in got
    assert em.near_duplicates(frame.where("false")).collect() == []


def test_forest_joins_what_the_matrix_joins():
    rng = np.random.default_rng(3)
    for _ in range(20):
        mask = rng.random((9, 7)) < 0.15
        ia, ib = np.arange(9), np.arange(100, 107)
        u, v = em.forest(mask, ia, ib)
        nodes = [*ia.tolist(), *ib.tolist()]
        want = helpers.components(nodes, [(int(ia[i]), int(ib[j])) for i, j in zip(*np.nonzero(mask))])
        assert helpers.components(nodes, zip(u.tolist(), v.tolist())) == want
