from __future__ import annotations

import zlib

import numpy as np

from corpusmill.llm import langid


def test_query_on_held_out_documents(spark, small):
    rows = langid.op10_langid(spark, small).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    named = [r for r in held if docs[r["doc_id"]]["lang"] is not None]
    right = sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in named)
    assert right >= 0.9 * len(named)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_predictions_use_the_text_only(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.fit(docs)
    plain = langid.identify(docs.select("doc_id", "text"), model).orderBy("doc_id").collect()
    other = langid.identify(docs.selectExpr("doc_id", "text", "'xx' AS lang", "null AS source"), model).orderBy("doc_id").collect()
    assert [(r["lang_pred"], r["score"]) for r in plain] == [(r["lang_pred"], r["score"]) for r in other]


def test_odd_texts_clashing_columns_and_no_rows(spark, small):
    model = langid.fit(spark.read.parquet(f"{small}/documents.parquet"))
    rows = [(1, None, "a"), (2, "", "b"), (3, "123 !? \n", "c"), (4, "the house and the tree " * 20000, "d"), (None, "the house", "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, Score string")
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (1, 2, 3))
    assert got[4]["lang_pred"] in model.languages
    assert langid.identify(docs.where("false"), model).collect() == []
    assert all(r["lang_pred"] == "und" for r in langid.identify(docs, None).collect())


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, None, "en")], "doc_id bigint, text string, lang string")
    assert langid.fit(docs) is None


def test_sums_do_not_cross_documents():
    texts = [b"abc", b"", b"z", b"hello world"]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    values = np.random.default_rng(1).random((langid.BUCKETS, 2))
    total, count = langid.document_sums(data, off, values)
    for i, t in enumerate(texts):
        one = langid.normal(np.frombuffer(t, np.uint8).copy())
        ids = np.concatenate([langid.subwords(one, k) for k in langid.ORDERS])
        assert count[i] == len(ids)
        assert np.allclose(total[i], values[ids].sum(axis=0))


def test_training_separates_and_calibrates():
    rng = np.random.default_rng(2)
    x = np.zeros((200, langid.BUCKETS), np.float32)
    y = np.arange(200) % 4
    for i in range(200):
        x[i, y[i] * 10 + rng.integers(0, 10, 30)] = 1
        x[i, 100 + rng.integers(0, 50, 30)] = 1
    x /= x.sum(axis=1, keepdims=True)
    model = langid.train(x, y, list("abcd"))
    assert ((x @ model.logits + model.bias).argmax(axis=1) == y).mean() > 0.97
    assert 0 < model.threshold <= 0.5


def test_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (1, 5, 700, 3, 0, 90)]
    values = rng.normal(size=(langid.BUCKETS, 3))
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = langid.document_sums(data, off, values)[0]
    for i, t in enumerate(texts):
        alone = langid.document_sums(np.frombuffer(t, np.uint8), np.array([0, len(t)]), values)[0]
        assert (together[i] == alone[0]).all()


def test_every_language_is_learned_also_repeated_rows_and_ties(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 60)
    rows = [(i, f"{chr(97 + i % 20)}{chr(98 + i % 20)} " * 30, f"l{i % 20:02d}") for i in range(400)] * 2
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.languages == [f"l{k:02d}" for k in range(20)]
