from __future__ import annotations

import random

import numpy as np
import pytest

from corpusmill.llm import simhash
from corpusmill.llm.components import connected_components
from tests.llm import helpers


def test_equals_brute_force(spark):
    docs = helpers.copies(random.Random(1))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == helpers.simhash(docs)


def test_query_equals_brute_force(spark, small):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op6_simhash(spark, small).collect()}
    assert got == helpers.simhash(docs)


def near_prints(seed: int, n: int = 300) -> np.ndarray:
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n, dtype=np.uint64) << np.uint64(1)
    for i in range(1, n):
        if i % 3:
            flips = rng.choice(64, size=rng.integers(1, 7), replace=False)
            base[i] = base[rng.integers(0, i)] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64))
    return np.unique(base)


@pytest.mark.parametrize("count", [300, 10**6, 10**8, 10**10, 10**12])
def test_no_link_is_lost_for_any_number_of_pieces(spark, count):
    prints = near_prints(count % 97)
    rows = [(int(f.view(np.int64)), i) for i, f in enumerate(prints)]
    links = simhash.fingerprint_links(spark.createDataFrame(rows, "fp bigint, rep bigint"), n=count)
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    want = helpers.components(list(range(len(prints))), [(a, b) for a in range(len(prints)) for b in range(a + 1, len(prints)) if (int(prints[a]) ^ int(prints[b])).bit_count() <= 4])
    assert {i: got.get(i, i) for i in want} == want


def test_large_groups_of_one_key_are_cut_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 32)
    rng = np.random.default_rng(5)
    # all agree on the upper half, so that several keys hold every fingerprint
    prints = np.unique(rng.integers(0, 2**30, 400, dtype=np.uint64))
    rows = [(int(f), i) for i, f in enumerate(prints)]
    links = simhash.fingerprint_links(spark.createDataFrame(rows, "fp bigint, rep bigint"))
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    want = helpers.components(list(range(len(prints))), [(a, b) for a in range(len(prints)) for b in range(a + 1, len(prints)) if (int(prints[a]) ^ int(prints[b])).bit_count() <= 4])
    assert {i: got.get(i, i) for i in want} == want


def test_hits_are_hamming_distances():
    prints, queries = near_prints(3, 200), near_prints(4, 70)
    queries = np.concatenate([queries, prints[:50] ^ np.uint64(0b1111)])
    for radius in (0, 1, 3, 4, 7):
        want = np.array([[(int(q) ^ int(p)).bit_count() <= radius for p in prints] for q in queries])
        assert (simhash.hits(prints, queries, radius) == want).all()


def test_nulls_ties_extra_columns_and_no_rows(spark):
    rows = [(None, "a b c d e f", 1), (7, "a b c d e f", 2), (7, "a b c d e f", 3), (None, "only here now and then", 4), (9, None, 5), (3, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, TEXT bigint")
    got = sorted(((r[0], r[2]) for r in simhash.simhash_components(docs).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (None, None), (9, 3), (3, 3)], key=str)
    assert simhash.simhash_components(docs.where("false")).collect() == []


def test_components_of_long_chains(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501), (501, 500), (7, 7), (None, 3)], "u bigint, v bigint")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {500: 500, 501: 500}


def test_the_centre_of_a_star_is_no_hot_key(spark, monkeypatch):
    from corpusmill.llm import components

    monkeypatch.setattr(components, "LIGHT", 50)
    monkeypatch.setattr(components, "HEAVY", 20)
    rng = random.Random(12)
    edges = [(10**6, k) for k in range(1, 2000)] + [(5, 10**7 + k) for k in range(700)] + [(rng.randrange(2 * 10**7, 2 * 10**7 + 300), rng.randrange(2 * 10**7, 2 * 10**7 + 300)) for _ in range(250)]
    links = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    want = helpers.components(sorted({n for e in edges if e[0] != e[1] for n in e}), edges)
    assert got == want
    both = links.unionByName(links.selectExpr("v AS u", "u AS v"))
    stats = components._minimum(both)
    plan = components._with_minimum(both, stats, both.count())._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan  # heavy nodes
    assert stats.where("n > 270").count() <= components.HEAVY
