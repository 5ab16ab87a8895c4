"""Properties of operators that no single query shows."""

import random

from pyspark.sql import functions as F

from sieveline.operators import components as C
from sieveline.operators import dense as D
from sieveline.operators import fusion as U
from sieveline.operators import lexical as L
from sieveline.operators import metrics as M


def run_of(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, rank int, score double")


def test_rrf_does_not_depend_on_order(spark):
    a = run_of(spark, [(1, 1, 1, 0.9), (1, 2, 2, 0.5)])
    b = run_of(spark, [(1, 2, 1, 0.8), (1, 3, 2, 0.1)])
    x, y = (sorted(map(tuple, U.rrf(*r).collect())) for r in ((a, b), (b, a)))
    assert x == y and dict((d, s) for _, d, s in x)[2] == 1 / 61 + 1 / 62


def test_rank_sum_of_absent_documents(spark):
    a, b = run_of(spark, [(1, 1, 1, 0.9)]), run_of(spark, [(1, 2, 1, 0.8)])
    assert {r["doc_id"]: r["score"] for r in U.rank_sum(a, b).collect()} == {1: 101.0, 2: 101.0}


def test_recall_grows_with_k_and_ndcg_of_the_ideal_is_one(spark):
    q = spark.createDataFrame([(1, d, g) for d, g in enumerate((3, 2, 0, 2, 1))], "query_id long, doc_id long, grade int")
    ideal = run_of(spark, [(1, d, i + 1, 1.0) for i, d in enumerate((0, 1, 3, 4, 2))])
    assert M.ndcg(q, ideal, {3: 1.0, 2: 0.1, 1: 0.01}).first()["ndcg"] == 1
    r = [M.recall(q, ideal, k).first()["recall"] for k in (1, 2, 3, 5)]
    assert r == sorted(r) and r[-1] == 1


def test_pairwise_counts_ties_half(spark):
    g = spark.createDataFrame([(1, 1, 3, 0.5), (1, 2, 0, 0.5), (1, 3, 0, 0.1)], "query_id long, doc_id long, grade int, score double")
    x = M.pairwise(g, F.col("grade") == 3, F.col("grade") == 0).first()
    assert (x["concordance"], x["n_pairs"]) == (0.75, 2)


def test_search_in_passes_gives_the_same(spark, sf, monkeypatch):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    q = v.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    one = sorted(map(tuple, D.search(q, v, 3).collect()))
    monkeypatch.setattr(D, "QUERY_BYTES", 2000)
    assert sorted(map(tuple, D.search(q, v.repartition(5), 3).collect())) == one


def test_components_of_paths_and_stars(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5000 + r.randint(0, 30), 5000 + r.randint(0, 30)) for _ in range(20)]
    got = {x["node"]: x["root"] for x in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for a, b in sorted(edges, key=max):
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in root}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_correction_prefers_small_distance_then_frequency(spark):
    v = spark.createDataFrame([("cable", 5), ("table", 9), ("cables", 50)], "term string, cf long")
    w = spark.createDataFrame([("cabel",), ("cable",), ("xable",), ("a1b",), ("ab",)], "word string")
    assert {r["word"]: r["correction"] for r in L.correct(w, v).collect()} == {"cabel": "cables", "xable": "table"}
