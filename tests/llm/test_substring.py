from __future__ import annotations

import random

import numpy as np
import pytest

from corpusmill.llm import substring
from tests.llm import helpers


def expected(docs):
    return {i: (n, n - len(kept), helpers.digest(kept)) for i, (kept, n) in helpers.kept_words(docs).items()}


@pytest.mark.parametrize("chunk_bytes, block_windows", [(1 << 20, 1 << 20), (2000, 300)])
def test_equals_brute_force(spark, chunk_bytes, block_windows):
    docs = helpers.copies(random.Random(2), 90)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    rows = substring.remove_repeated(frame, digest=True, chunk_bytes=chunk_bytes, block_windows=block_windows).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == expected(docs)


def test_query_equals_brute_force(spark, small):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.op9_substring(spark, small).collect()}
    assert got == expected(docs)


def test_texts_and_other_columns(spark):
    rng = random.Random(3)
    a, b = helpers.prose(rng, 30), helpers.prose(rng, 15)
    rows = [(2, f"{b}\n\n{a}  {b}", "x", 9), (1, f" {a}\n", "y", 9), (3, None, "z", 9), (4, "  kept   as\tit is ", "u", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, Text string, n_words int")
    got = {r["doc_id"]: (r["text"], r["n_words"], r["n_removed"]) for r in substring.remove_repeated(docs).collect()}
    assert got == {1: (f" {a}\n", 30, 0), 2: (f"{b} {b}", 60, 30), 3: (None, 0, 0), 4: ("  kept   as\tit is ", 4, 0)}


def test_null_ids_come_first_and_rows_of_one_id_are_ordered_by_text(spark):
    text = helpers.prose(random.Random(4), 25)
    docs = spark.createDataFrame([(None, text), (1, text), (1, text), (5, text + " z"), (5, text + " a")], "doc_id bigint, text string").coalesce(1)
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring.remove_repeated(docs, digest=True).collect())
    assert got == [(0, 0), (1, 25), (1, 25), (5, 25), (5, 25)]


def test_no_rows_and_no_words(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert substring.remove_repeated(docs, digest=True).collect() == []
    docs = spark.createDataFrame([(1, None), (2, " ")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["n_words"] for r in substring.remove_repeated(docs, digest=True).collect()} == {1: 0, 2: 0}


@pytest.mark.parametrize("dtype, top", [("u2", 2**20), ("u4", 2**40), ("u8", 2**56)])
def test_delta_coding_round_trip(dtype, top):
    values = np.unique(np.random.default_rng(1).integers(0, top, 500, dtype=np.uint64))
    raw = substring.delta_encode(values, dtype)
    assert (substring.delta_decode(raw, int(values[0]), dtype) == values).all()


def test_one_passage_in_very_many_documents(spark):
    """The bulk of all documents shares one passage; only the first keeps it."""
    rng = random.Random(6)
    passage = helpers.prose(rng, 50)
    docs = [(i, f"{helpers.prose(rng, 3, 10**6)} {passage} {helpers.prose(rng, 3, 10**6)}") for i in range(600)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    rows = substring.remove_repeated(frame, digest=True, chunk_bytes=5000, block_windows=2000).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == expected(docs)


def test_sketches_add_up_and_never_count_too_little():
    import pyarrow as pa

    rng = random.Random(3)
    texts = [helpers.prose(rng, 400, 10**6) for _ in range(6)]
    texts += [texts[0], f"{texts[1]} {texts[1]}"]
    chunks = []
    for part in (texts[:4], texts[4:]):
        rows = pa.record_batch({"doc_id": pa.array(range(len(part)), pa.int64()), "text": part})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_batch(rows)
        chunks.append(substring.Chunk(sink.getvalue(), 20))
    bits, cell_bits = 1, 14
    rows = [(k, block, *(substring.delta_encode(c.sketch(lo, hi, r, bits, cell_bits), "u4") for r in range(2))) for k, c in enumerate(chunks) for block, lo, hi in c.blocks(bits)]
    found: list[set] = [set(), set()]
    for block in (0, 1):
        own = [r for r in rows if r[1] == block]
        group = pa.table({"chunk": [r[0] for r in own], "block": [r[1] for r in own], "row0": [r[2] for r in own], "row1": [r[3] for r in own]})
        merged = substring.merge_sketches(group, "u4", cell_bits)
        for k, bit in zip(merged.column("chunk").to_pylist(), merged.column("bits").to_pylist()):
            found[k].add((block, bit))
    times: dict = {}
    for c in chunks:
        for h, n in zip(c.h1.tolist(), c.times.tolist()):
            times[h] = times.get(h, 0) + n
    passed = single = 0
    for k, c in enumerate(chunks):
        import numpy as np

        mine = set(c.candidates(bits, cell_bits, {b: np.frombuffer(x, np.uint8) for b, x in found[k]}).tolist())
        assert {i for i, h in enumerate(c.h1.tolist()) if times[h] > 1} <= mine
        single += sum(times[h] == 1 for h in c.h1.tolist())
        passed += sum(times[c.h1[i]] == 1 for i in mine)
    assert passed < 0.1 * single
