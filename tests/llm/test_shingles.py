from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from corpusmill.llm import shingles
from tests.llm import helpers

DDL = "doc_id bigint, text string"


def sets(docs: list) -> dict:
    out = {}
    for i, text in docs:
        w = helpers.words(helpers.lower(text or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))}
    return out


def groups(docs: list) -> dict:
    s = sets(docs)
    ids = list(s)
    similar = lambda a, b: s[a] == s[b] or 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b]) > 0
    return helpers.components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if similar(a, b)])


def found(spark, docs: list) -> dict:
    rows = shingles.similar_groups(spark.createDataFrame(docs, DDL)).collect()
    least: dict = {}
    for r in rows:
        least[r["root"]] = min(r["doc_id"], least.get(r["root"], r["doc_id"]))
    return {r["doc_id"]: least[r["root"]] for r in rows}


def edited(rng: random.Random, text: str, edits: int) -> str:
    w = text.split(" ")
    for k in rng.sample(range(len(w)), edits):
        w[k] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def mixed(seed: int) -> list:
    rng = random.Random(seed)
    base = [helpers.letters(rng, n, 10**6) for n in (3, 5, 8, 40, 60, 100, 150, 300, 900)]
    out = list(base) + ["", " ", None, base[0]]
    for t in base[3:]:
        out += [edited(rng, t, max(1, len(t.split(" ")) * k // 200)) for k in range(1, 10)]
    common = helpers.letters(rng, 30, 10**6)
    out += [f"{common} {helpers.letters(rng, rng.choice([2, 5, 8, 60]), 10**6)}" for _ in range(40)]
    return list(enumerate(out))


@pytest.mark.parametrize("block, run", [(1024, 256), (8, 4), (16, 64)])
def test_equals_brute_force(spark, monkeypatch, block, run):
    monkeypatch.setattr(shingles, "BLOCK", block)
    monkeypatch.setattr(shingles, "RUN", run)
    docs = mixed(block)
    assert found(spark, docs) == groups(docs)


def test_stage_joins_similar_documents_that_simhash_leaves(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, small).collect()}
    want = groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert want[177] == 1  # similarity 0.83, more than 4 bits apart
    assert got == {i for i, c in want.items() if i == c}


def test_sketches_differ_in_no_more_places_than_sets():
    rng = np.random.default_rng(1)
    for n in (1, 50, 70, 1000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 10], rng.integers(0, 2**63, n // 20, dtype=np.uint64)]))
        i, j = shingles.close_pairs(np.array([len(a), len(b)]), [shingles.sketch(a), shingles.sketch(b)], np.arange(2), np.zeros(2, int))
        assert len(i) == 1
