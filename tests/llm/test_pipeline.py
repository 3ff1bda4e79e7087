from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corpusmill.llm import decontaminate, langid, packing
from tests.llm import helpers, test_shingles

COLUMNS = corpus_pipeline.COLUMNS


def texts(df) -> dict[int, str | None]:
    return {r["doc_id"]: r["text"] for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark, small):
    """The documents before the first and after each stage but the last, and the last one's rows."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), helpers.DOCS)
        out.append(docs)
    return out, corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "benchmark_free", "packed"]
    assert all(df.columns == COLUMNS for df in stages[0])


def test_language_keeps_clean_documents(spark, stages):
    before, after = stages[0][0], stages[0][1]
    model = langid.fit(before)
    gone = set(texts(before)) - set(texts(after))
    assert gone == {r["doc_id"] for r in langid.identify(before, model).where("rejected").collect()}
    assert len(gone) <= 0.1 * before.count()


def test_one_document_of_each_group_stays(stages):
    before, after = (texts(d) for d in stages[0][1:3])
    assert set(after) == {i for i, c in test_shingles.groups(list(before.items())).items() if i == c}


def test_repeated_passages_go(stages):
    before, after = (texts(d) for d in stages[0][2:4])
    kept = helpers.kept_words(list(before.items()))
    assert set(after) == {i for i, (w, n) in kept.items() if w or not n}
    for i, text in after.items():
        words, n = kept[i]
        assert text == (before[i] if len(words) == n else " ".join(words))


def test_language_equals_plain_python(spark, small, stages):
    """The model's decision, document by document, without batches and running sums."""
    model = langid.fit(stages[0][0])
    kept = set(texts(stages[0][1]))
    for i, text in texts(stages[0][0]).items():
        raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c for c in text or "").encode()
        z = np.zeros(len(model.languages))
        count = 0
        for order in langid.ORDERS:
            for k in range(len(raw) - order + 1):
                h = (0x811C9DC5 + order) & 0xFFFFFFFF
                for byte in raw[k : k + order]:
                    h = ((h ^ byte) * 0x01000193) & 0xFFFFFFFF
                h ^= h >> 15
                z += model.logits[(h * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - langid.BUCKETS.bit_length() + 1)]
                count += 1
        z = (z / max(1, count) + model.bias) / model.temperature
        score = 1 / np.exp(z - z.max()).sum()
        if abs(score - model.threshold) > 1e-9:
            assert (i in kept) == (any(c.isalpha() for c in text or "") and score >= model.threshold), i


def test_near_duplicates_keep_one_row(spark, small):
    text = "one and the same text of more than five words"
    rows = [(7, text, "en", "s", 1), (7, text, "en", "s", 1), (7, "another text that stands under that same number here", "en", "s", 1), (None, "no number", "en", "s", 1), (None, "no number", "en", "s", 1), (None, text, "en", "s", 1)]
    docs = spark.createDataFrame(rows, helpers.DOCS)
    got = corpus_pipeline.near_duplicates(spark, docs, small).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("7", text), ("7", rows[2][1]), ("None", "no number")])


def test_contaminated_documents_go(spark, small, stages):
    before, after = stages[0][3:5]
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    hit = {r["doc_id"] for r in decontaminate.decontaminate(before, bench).where("contaminated").collect()}
    assert set(texts(after)) == set(texts(before)) - hit


def test_packed_rows_hold_all_ids(stages):
    docs, rows = texts(stages[0][-1]), stages[1]
    whole = Tokenizer.from_file(packing.default_tokenizer())
    for i, text in docs.items():
        ids = whole.encode(text or "", add_special_tokens=False).ids + [packing.END]
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[r["start"] : r["start"] + r["length"]])) for r in own)


def test_run_equals_the_stages(spark, small, stages):
    key = lambda r: (r["doc_id"], r["start"])
    got = corpus_pipeline.run(spark, small).collect()
    # which pieces share a sequence may depend on how rows are dealt to tasks; the pieces don't
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert [tuple(r[c] for c in columns) for r in sorted(got, key=key)] == [tuple(r[c] for c in columns) for r in sorted(stages[1], key=key)]
    assert len({r["sequence_id"] for r in got}) == len({r["sequence_id"] for r in stages[1]})


def test_stages_on_odd_documents(spark, small):
    rng = random.Random(1)
    long = helpers.prose(rng, 30000)
    rows = [(None, None, None, None, None), (None, "x", "en", "s", 1), (1, None, "en", "s", 0), (2, "", None, "s", 0), (3, long, "en", "s", len(long)), (4, long, "en", "s", len(long)), (4, long, "en", "s", len(long)), (5, " \n\t ", "de", None, 4)]
    docs = spark.createDataFrame(rows, helpers.DOCS)
    clashing = docs.selectExpr("*", "text AS TEXT", "1 AS removed")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), small).collect() == [], name
        assert stage(spark, docs, small).columns == COLUMNS
        stage(spark, docs, small).collect()
    for (name, stage), df in ((s, d) for s in corpus_pipeline.STAGES for d in (docs, clashing)):
        stage(spark, df, small).collect()
    near = corpus_pipeline.near_duplicates(spark, docs, small).collect()
    assert sorted(r["doc_id"] for r in near if r["doc_id"] in (3, 4)) == [3]
