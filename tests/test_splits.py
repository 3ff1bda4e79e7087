from __future__ import annotations

import random

import numpy as np
import pytest

from corpusmill.functions import planning
from corpusmill.functions.indexing import with_row_index
from corpusmill.functions.planning import SplitCounts
from corpusmill.operators import balance, splits


def lines(spark, n: int):
    return spark.range(n).selectExpr("id AS line_no", "concat('line ', id) AS value").repartition(3)


def test_row_index_is_dense_and_ordered(spark):
    got = with_row_index(lines(spark, 1000), "line_no", name="i", start=5).collect()
    assert {r["line_no"]: r["i"] for r in got} == {i: i + 5 for i in range(1000)}
    assert with_row_index(lines(spark, 0), "line_no").collect() == []


def test_round_robin(spark):
    assert {r["line_no"]: r["split_idx"] for r in splits.round_robin(lines(spark, 103), 8).collect()} == {i: i % 8 for i in range(103)}


@pytest.mark.parametrize("n, k", [(103, 8), (8, 8), (5, 8), (64, 8), (1, 1)])
def test_shuffled_splits_have_the_sizes_of_array_split(spark, n, k):
    rows = splits.shuffled_splits(lines(spark, n), k, seed=3).collect()
    sizes = [sum(r["split_idx"] == i for r in rows) for i in range(k)]
    assert sizes == [len(x) for x in np.array_split(np.arange(n), k)]
    for i in range(k):
        assert sorted(r["pos"] for r in rows if r["split_idx"] == i) == list(range(sizes[i]))
    assert sorted(r["line_no"] for r in rows) == list(range(n))


def test_shuffles_depend_on_the_seed_only(spark):
    run = lambda seed, parts: {r["line_no"]: (r["split_idx"], r["pos"]) for r in splits.shuffled_splits(lines(spark, 200).repartition(parts), 4, seed=seed).collect()}
    assert run(1, 2) == run(1, 7) != run(2, 2)
    moved = {r["line_no"]: r["pos"] for r in splits.bucket_shuffle(lines(spark, 200), 5, seed=1).collect()}
    assert any(p != i // 5 for i, p in moved.items())


def test_labels(spark):
    counts = planning.split_counts(1, train=32, dev_ratio=0.2, test_ratio=0.1)
    assert counts == SplitCounts(32, 9, 4)
    rows = splits.with_labels(splits.round_robin(lines(spark, 45), 45), counts).collect()
    names = {r["split_idx"]: (r["dataset_type"], r["shard_no"], r["split_name"]) for r in rows}
    assert names[0] == ("train", 1, "train_1_of_32") and names[31] == ("train", 32, "train_32_of_32")
    assert names[32] == ("test", 1, "test_1_of_4") and names[35] == ("test", 4, "test_4_of_4")
    assert names[36] == ("dev", 1, "dev_1_of_9") and names[44] == ("dev", 9, "dev_9_of_9")


def test_guards(spark):
    with pytest.raises(ValueError):
        splits.require_lines(lines(spark, 0), 4)
    with pytest.raises(ValueError):
        splits.require_lines(lines(spark, 100), 128)
    splits.require_lines(lines(spark, 130), 128)
    counts = SplitCounts(3, 1, 1)
    with pytest.raises(ValueError):
        splits.require_filled(splits.with_labels(splits.round_robin(lines(spark, 3), 5), counts), counts)


def test_split_counts():
    assert planning.split_counts(1, 4, 2, 1) == SplitCounts(4, 2, 1)
    assert planning.split_counts(1) == SplitCounts(32, 0, 0)
    assert planning.split_counts(50).train == 128 and planning.split_counts(500).train == 256
    for bad in ({"train": 3, "dev": 1}, {"dev": 1, "test": 1}, {"train": 3, "dev": 1, "test": 1, "dev_ratio": 0.1}, {"dev_ratio": 0.6, "test_ratio": 0.4}):
        with pytest.raises(ValueError):
            planning.split_counts(1, **bad)


def test_training_arithmetic():
    assert planning.adjust_splits(32, 5) == 35 and planning.adjust_splits(10, 5) == 10
    with pytest.raises(ValueError):
        planning.adjust_splits(0, 4)
    assert planning.shuffle_mode((2 << 30) - 1) == "on_RAM" and planning.shuffle_mode(2 << 30) == "large_file"
    assert planning.sequence_length({"n_positions": 5}) == 5 and planning.sequence_length({"n_positions": 5, "max_position_embeddings": 6}) == 6
    with pytest.raises(ValueError):
        planning.sequence_length({})
    need = 32 * 1 * 2 * 10 * 3
    assert planning.splits_for_one_batch(need, 32, 4, 2, 1, 10) == 32
    assert planning.splits_for_one_batch(need - 1, 32, 4, 2, 1, 10) == 8
    with pytest.raises(ValueError):
        planning.splits_for_one_batch(10, 32, 4, 2, 1, 10)


def model(counts: list[int]) -> list[list[tuple[int, int]]]:
    """Rows (old shard, old place) of each shard, one move at a time."""
    target = planning.row_targets(sum(counts), len(counts))
    files = [[(s, r) for r in range(n)] for s, n in enumerate(counts)]
    surplus = []
    for f, t in zip(files, target):
        surplus += f[t:]
        del f[t:]
    for f, t in zip(files, target):
        while len(f) < t:
            f.append(surplus.pop(0))
    return files


def test_rebalancing_equals_a_model(spark):
    rng = random.Random(1)
    cases = [[5, 0, 1], [3], [4, 4, 4], [0, 0, 7], [1, 2, 3, 4, 5], *[[rng.randrange(12) for _ in range(rng.randrange(1, 7))] for _ in range(20)]]
    rows = [(f"t{c}", s, r, s * 100 + r) for c, counts in enumerate(cases) for s, n in enumerate(counts) for r in range(n)]
    shards = [(f"t{c}", s) for c, counts in enumerate(cases) for s in range(len(counts))]
    got = balance.rebalance(spark.createDataFrame(rows, "dataset_type string, shard_no int, seq bigint, old int"), spark.createDataFrame(shards, "dataset_type string, shard_no int")).collect()
    found = {(r["dataset_type"], r["shard_no"], r["seq"]): (r["old"] // 100, r["old"] % 100) for r in got}
    want = {(f"t{c}", s, i): row for c, counts in enumerate(cases) for s, f in enumerate(model(counts)) for i, row in enumerate(f)}
    assert found == want
