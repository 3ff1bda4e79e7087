from __future__ import annotations

import random
import struct
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusmill.llm import packing
from tests.llm import helpers


def check(rows, docs: list, length: int = packing.SEQUENCE) -> None:
    """Every document's ids lie in exactly one piece each, and sequences are gapless from 0."""
    whole = Tokenizer.from_file(packing.default_tokenizer())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == {i for i, _ in docs}
    for i, text in docs:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [packing.END]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            part = ids[at : at + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r["length"]
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    total = sum(r["length"] for r in rows)
    if total > 20 * length:
        assert len(sequences) * length <= 1.05 * total


def test_round_trip(spark):
    odd = ["", " ", "  two  spaces ", "tab\tand\nline \n end", "it's <s> </s> 12345 x", "日本語 テキスト", " lead", "trail ", "a b  c", "\r\n\r\n x", "word " * 6000]
    docs = [(i, t) for i, t in enumerate(odd)] + [(100, None)] + [(200 + i, t) for i, t in helpers.copies(random.Random(1))]
    check(packing.pack(spark.createDataFrame(docs, "doc_id bigint, text string"), packing.default_tokenizer()).collect(), docs)


def test_query(spark, small):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    check(packing.op4_packing(spark, small).collect(), docs)


def test_shorter_sequences_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c " * 20), (1, "a b c " * 20), (None, "x"), (2, None)], "doc_id bigint, text string").selectExpr("*", "3 AS TEXT")
    rows = packing.pack(docs, packing.default_tokenizer(), length=16, with_ids=True).collect()
    assert sorted((r["doc_id"] or 0) for r in rows if r["start"] == 0) == [0, 1, 1, 2]
    assert all(len(r["ids"]) == 4 * r["length"] and r["offset"] + r["length"] <= 16 for r in rows)
    assert packing.pack(docs.where("false"), packing.default_tokenizer()).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=30))
def test_patterns_hold_the_histogram(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    found = defaultdict(int)
    for count, pattern in patterns:
        assert count > 0 and sum(pattern) <= 64
        for size in pattern:
            found[size] += count
    assert found == histogram


def test_patterns_leave_little_padding():
    rng = random.Random(1)
    histogram = defaultdict(int)
    for _ in range(20000):
        histogram[min(2048, int(rng.expovariate(1 / 500)) + 1)] += 1
    patterns = packing.shortest_pack_first(histogram)
    used, made = sum(k * v for k, v in histogram.items()), sum(c for c, _ in patterns) * 2048
    assert used / made > 0.97


def test_slots_are_found_by_rank():
    histogram = {5: 7, 3: 9, 1: 4}
    where = packing.slots(packing.shortest_pack_first(histogram, 8))
    assert [int(x) for x in where["length"]] == sorted(int(x) for x in where["length"])
    assert {int(n) for n in where["length"]} == set(histogram)


@pytest.mark.parametrize("text", ["a  b", "x \n y", "  ", "don't stop", "1 2 3", "ß ñ 漢字 😀 é"])
def test_word_by_word_encoding_equals_the_library(text):
    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        definition = f.read()
    ids = Tokenizer.from_str(definition).encode(text, add_special_tokens=False).ids
    assert packing.encoder(definition)(text) == struct.pack(f"<{len(ids)}I", *ids)
