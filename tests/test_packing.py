from __future__ import annotations

import random

import pytest

from corpusmill.config import PackingConfig, PrepOptions
from corpusmill.operators import packing

LENGTH = 5
LENGTHS = [3, 2, 10, 2, 2, 5]
#: (completion tokens, padding) of each sequence.
GOLDEN = {
    "single::drop": [(3, 2), (2, 3), (2, 3), (2, 3), (5, 0)],
    "single::truncate_left": [(3, 2), (2, 3), (5, 0), (2, 3), (2, 3), (5, 0)],
    "single::truncate_right": [(3, 2), (2, 3), (5, 0), (2, 3), (2, 3), (5, 0)],
    "greedy::drop": [(5, 0), (4, 1), (5, 0)],
    "greedy::truncate_left": [(5, 0), (5, 0), (4, 1), (5, 0)],
    "greedy::truncate_right": [(5, 0), (5, 0), (4, 1), (5, 0)],
    "full": [(5, 0), (5, 0), (5, 0), (5, 0), (4, 1)],
}


def articles(spark, lengths: list[int], split: int = 0):
    rows = [(split, line, 0, [(line * 1000 + i, 1, -1) for i in range(n)]) for line, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "split_idx bigint, line_no bigint, art_no bigint, tokens array<struct<token_id:int,token_type:int,category_id:int>>")


def packed(df, name: str, length: int) -> list[list]:
    rows = packing.pack(df, PackingConfig.parse(name), length, -7).collect()
    return [r["tokens"] for r in sorted(rows, key=lambda r: (r["split_idx"], r["seq"]))]


def model(lengths: list[int], name: str, length: int) -> list[list[int]]:
    """Sequences of token ids without padding, one token at a time."""
    style, _, overflow = name.partition("::")
    stream = [[line * 1000 + i for i in range(n)] for line, n in enumerate(lengths)]
    if style == "full":
        flat = [t for a in stream for t in a]
        return [flat[i : i + length] for i in range(0, len(flat), length)]
    out: list[list[int]] = []
    current: list[int] = []
    for a in stream:
        if style == "greedy" and len(current) + len(a) <= length:
            current = current + a
            continue
        out += [current] if current else []
        fits = a if len(a) <= length else [] if overflow == "drop" else a[-length:] if overflow == "truncate_left" else a[:length]
        current = fits
    return out + ([current] if current else [])


@pytest.mark.parametrize("name", PackingConfig.names())
def test_golden_vectors(spark, name):
    found = [(sum(t.token_type == 1 for t in s), sum(t.token_type == 2 for t in s)) for s in packed(articles(spark, LENGTHS), name, LENGTH)]
    assert found == GOLDEN[name]


@pytest.mark.parametrize("name", PackingConfig.names())
def test_equals_a_token_by_token_model(spark, name):
    rng = random.Random(name)
    lengths = [rng.choice([0, 1, 2, 3, 5, 7, 8, 9, 20]) for _ in range(120)]
    found = packed(articles(spark, lengths), name, 8)
    assert all(len(s) == 8 for s in found)
    assert [[t.token_id for t in s if t.token_type == 1] for s in found] == model(lengths, name, 8)
    assert all(t.token_id == -7 and t.category_id == -1 for s in found for t in s if t.token_type == 2)


@pytest.mark.parametrize("name", ["full", "greedy::drop", "single::drop"])
def test_oversize_articles_only_and_no_articles(spark, name):
    only = [[t.token_id for t in s if t.token_type == 1] for s in packed(articles(spark, [6, 6, 6, 6]), name, LENGTH)]
    assert only == model([6, 6, 6, 6], name, LENGTH)
    assert packed(articles(spark, [0, 0]), name, LENGTH) == []
    assert packed(articles(spark, [1]).where("false"), name, LENGTH) == []


@pytest.mark.parametrize("name", ["full", "greedy::drop"])
def test_splits_are_packed_apart(spark, name):
    both = articles(spark, LENGTHS, 0).unionByName(articles(spark, [4, 4, 1], 1))
    found = packing.pack(both, PackingConfig.parse(name), LENGTH, -7)
    assert {r["split_idx"]: r["n"] for r in found.groupBy("split_idx").agg(packing.F.count("*").alias("n")).collect()} == {0: len(GOLDEN[name]), 1: 2}


@pytest.mark.parametrize("overflow, kept", [("drop", None), ("truncate_left", [1, 2, 3, 4, 5]), ("truncate_right", [0, 1, 2, 3, 4])])
def test_overflow(spark, overflow, kept):
    row = articles(spark, [6]).select(packing.truncated(packing.F.col("tokens"), LENGTH, overflow).alias("t")).first()
    assert (row["t"] and [t.token_id for t in row["t"]]) == kept


def test_prompt_only_sequences_go_and_separators_do_not_count(spark):
    rows = [(0, [(1, 0, -1), (2, 2, -1)]), (1, [(1, 3, -1), (2, 2, -1)]), (2, [(1, 0, -1), (2, 1, -1)])]
    df = spark.createDataFrame(rows, "seq int, tokens array<struct<token_id:int,token_type:int,category_id:int>>")
    assert [r["seq"] for r in packing.without_prompt_only(df).collect()] == [2]


def test_matrix(spark):
    found = packing.to_matrix(packing.pack_full(articles(spark, [3]), 4, -7)).first()
    assert (found["input_ids"], found["token_type_ids"], found["category_ids"]) == ([0, 1, 2, -7], [1, 1, 1, 2], [-1] * 4)


def test_names():
    assert [str(PackingConfig.parse(n)) for n in PackingConfig.names()] == PackingConfig.names()
    assert len(PackingConfig.names()) == 7
    for bad in ("full::drop", "greedy", "single", "other", "greedy::left"):
        with pytest.raises(ValueError):
            PackingConfig.parse(bad)
    for bad in ({"max_seq_length": 0}, {"packing_boundary": "x"}, {"attention_boundary": "x"}):
        with pytest.raises(ValueError):
            PrepOptions(**bad)


@pytest.mark.parametrize("name", ["pack_full", "padding_by_sequence", "pack_single_truncate_right", "pack_greedy_truncate_right_sequences", "pack_greedy_drop", "dropped_tokens_single_drop"])
def test_no_text_and_no_typed_token_is_written_or_shuffled(spark, small, name, monkeypatch):
    from corpusmill.functions import indexing
    from corpusmill.plans import queries

    seen = []
    for module in (indexing, queries):
        monkeypatch.setattr(module, "written", lambda df, write=module.written: seen.append(df) or write(df))
    seen.append(queries.QUERIES[name](spark, small))
    wide = [f for df in seen[:-1] for f in df.schema if f.dataType.simpleString() not in ("bigint", "int", "array<int>")]
    assert len(seen) > 1 and not wide
    assert "token_type" not in seen[-1]._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", PackingConfig.names())
def test_bare_ids_are_packed_like_typed_tokens(spark, name):
    rng = random.Random(name)
    typed = articles(spark, [rng.choice([0, 1, 5, 8, 9, 20]) for _ in range(60)])
    found = packing.pack(typed.withColumn("tokens", packing.F.col("tokens.token_id")), PackingConfig.parse(name), 8, -7).collect()
    assert [r["tokens"] for r in sorted(found, key=lambda r: r["seq"])] == [[t.token_id for t in s] for s in packed(typed, name, 8)]
