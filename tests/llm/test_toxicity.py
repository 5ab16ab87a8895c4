import zlib

import numpy as np
import pytest

from sieveline.llm import toxicity as m


def tables(spark, sf):
    base = f"/root/testdata/{sf}"
    return spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")


@pytest.fixture(scope="module")
def labelled(spark):
    return tables(spark, "sf0.01")


@pytest.mark.parametrize(("sf", "recall", "precision"), [("sf0.1", 0.8, 0.8), ("sf0.01", 0.6, 0.35)])
def test_held_out_recall_and_precision(spark, sf, recall, precision):
    docs, labels = tables(spark, sf)
    scored = m.score(docs, m.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    found = ((scored.predicted == 1) & (scored.toxic == 1)).sum()
    assert found >= recall * scored.toxic.sum() and found >= precision * scored.predicted.sum()
    assert scored.score.between(0, 1).all()


def test_training_never_sees_held_out_rows(spark, labelled):
    docs, labels = labelled
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(m.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    rows = lambda x: sorted(map(tuple, m.sample(docs, x).collect()))
    assert rows(labels) == rows(flipped) and rows(labels)
    for i in (1, 7, 123):
        assert spark.createDataFrame([(i,)], "doc_id long").select(m.held_out().alias("h")).first()["h"] == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_the_sample_is_bounded_in_rows_and_bytes_and_not_by_length(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(i, "long text " * 3000 if i % 2 else "short") for i in ids] * 2 + [(ids[0], None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    assert m.sample(docs, labels).count() == len(ids) + 1
    assert m.sample(docs, labels, max_rows=7).count() == 7
    own = m.sample(docs, labels, max_bytes=70_000).collect()
    assert 60_000 <= sum(len(r["text"]) for r in own) <= 70_000 and {len(r["text"]) for r in own} >= {5, 30_000}
    assert m.sample(docs, labels).rdd.getNumPartitions() == 1


def test_unseen_misspellings_share_grams():
    texts = [f"calm words all around {i} horridword" if i % 2 else f"calm words all around {i}" for i in range(400)]
    f = m.scorer(m.fit(texts, [i % 2 for i in range(400)]))
    good, bad = f(["calm words all around", "calm horridwords around"])
    assert good < 0.7 <= bad


def test_a_margin_is_the_mean_over_all_words_of_a_text_of_any_length():
    weights = np.random.default_rng(0).normal(size=m.BUCKETS).astype(np.float32)
    model = m.Model(weights, bias=0.25)
    texts = ["one two Two", "", "...", "word " * 5000 + "vile"]
    want = [0.25 + (weights[m.grams(m.WORD.findall(t.lower()))[0]].mean() if m.WORD.search(t) else 0.0) for t in texts]
    assert m.margins(texts, model, {}) == pytest.approx(want, abs=1e-5)
    bags = m.Bags(texts)
    assert bags.margins(np.arange(4), weights[bags.used], 0.25) == pytest.approx(want, abs=1e-5)


def test_the_cut_has_the_best_f1():
    z, y = np.array([0.9, 0.8, 0.7, 0.6, 0.1]), np.array([1, 1, 0, 1, 0])
    assert m.best_cut(z, y) == pytest.approx(0.35)


def test_grams_by_word():
    buckets, owners = m.grams(["ab", "", "ünï"])
    assert [int((owners == i).sum()) for i in range(3)] == [3, 0, 6]
    assert set(buckets[owners == 0]) == set(m.grams(["ab"])[0])


def test_odd_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = m.train(odd_docs, none)
    assert {r["score"] for r in m.score(odd_docs, model).collect()} == {0.0}
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(100, 114)] + [(101, None, None), (None, 1, 1), (101, 0, 1), (101, 0, 1)], "doc_id long, quality int, toxic int")
    model = m.train(odd_docs, marks)
    out = m.score(odd_docs, model)
    assert out.count() == odd_docs.count() and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    kept = m.clean(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == out.where("predicted = 0").count()
    assert m.score(no_docs, model).count() == m.clean(no_docs, model).count() == 0
    one = spark.createDataFrame([(i, 1, int(i == 105)) for i in range(100, 114)], "doc_id long, quality int, toxic int")
    assert m.score(odd_docs, m.train(odd_docs, one)).count() == odd_docs.count()
