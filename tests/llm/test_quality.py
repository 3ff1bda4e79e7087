from __future__ import annotations

import numpy as np

from corpusmill.llm import quality


def test_query_scores_every_document(spark, small):
    rows = quality.op1_quality(spark, small).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect())
    assert all(0 <= r[c] <= 1 for r in rows for c in ("text_score", "meta_score", "score"))
    assert all(r["quality"] == (r["score"] >= 0.5) for r in rows)


def test_held_out_labels(spark):
    """Two thirds of the labels train; the rest is predicted better than by the most frequent label."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 3 <> 0"))
    pairs = quality.score(docs, model).join(labels.where("doc_id % 3 = 0").withColumnRenamed("quality", "truth"), "doc_id").select("quality", "truth", "score").collect()
    truth = np.array([p["truth"] for p in pairs])
    right = np.mean([p["quality"] == p["truth"] for p in pairs])
    assert right >= max(truth.mean(), 1 - truth.mean()) - 0.02
    s = np.array([p["score"] for p in pairs])
    auc = (s[truth == 1][:, None] > s[truth == 0][None, :]).mean() + 0.5 * (s[truth == 1][:, None] == s[truth == 0][None, :]).mean()
    assert auc > 0.6


def test_views_teach_each_other():
    """With few labels, pseudo-labels of either view improve the other."""
    rng = np.random.default_rng(1)
    n = 3000
    y = rng.integers(0, 2, n).astype(float)
    t = (rng.standard_normal((n, 40)) + (y * 2 - 1)[:, None] * 0.45).astype(np.float32)
    m = (rng.standard_normal((n, 10)) + (y * 2 - 1)[:, None] * 1.0).astype(np.float32)
    known, pool, test = slice(0, 60), slice(60, 2000), slice(2000, n)
    right = {}
    for rounds in (0, 5):
        model = quality.co_train(t[known], m[known], y[known], t[pool], m[pool], rounds=rounds)
        right[rounds] = ((model.text.margin(t[test]) > 0) == (y[test] == 1)).mean()
        assert ((model.scores(t[test], m[test])[2] >= 0.5) == (y[test] == 1)).mean() > 0.9
    assert right[5] >= right[0]


def test_odd_rows(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = [(1, None, None, None, None), (2, "", "s", "en", -5), (None, "x " * 100000, "s", None, 10**12), (2, "", "s", "en", -5)]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint").withColumn("SCORE", quality.F.lit("x"))
    got = quality.score(odd, model).collect()
    assert len(got) == 4 and all(np.isfinite(r["score"]) for r in got)
    assert quality.score(odd.where("false"), model).collect() == []
    assert {r["quality"] for r in quality.score(odd, None).collect()} == {1}


def test_contradicting_and_missing_labels(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (3, 7)], "doc_id bigint, quality int")
    assert quality.fit(docs, labels) is None
    assert quality.fit(docs.where("false"), labels) is None
