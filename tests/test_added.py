"""Approximate search, aliases, sections, thresholds, resampling and models, against brute force or stated accuracy."""

import math
import os
import random
import signal

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline import plans
from sieveline.functions import text as T
from sieveline.operators import dense as D
from sieveline.operators import fusion as U
from sieveline.operators import stats as S
from sieveline.operators.late import max_sim
from sieveline.plans import analysis, registry
from sieveline.sources import io
from sieveline.streaming import ledger


def test_approximate_search_has_its_recall(spark, sf):
    exact, found = ({(r["query_id"], r["doc_id"]): r["score"] for r in plans.queries()[n](spark, sf).collect()} for n in ("j9_dense_topk", "r6_ann"))
    assert len(exact) == len(found) and sum(k in exact for k in found) >= 0.9 * len(exact)
    assert all(exact[k] == s for k, s in found.items() if k in exact)


def test_every_vector_is_in_a_list_and_all_probes_are_exact(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(200)] + [(500 + i, [0.0] * 6) for i in range(3)] + [(600 + i, [1.0] * 6) for i in range(90)]
    v = spark.createDataFrame(rows, "doc_id long, v array<double>")
    q = v.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    c = D.centres(v, 8, sample=50)
    assert c.shape == (8, 6) and D.assign(v, c).count() == len(rows)
    both = [sorted(map(tuple, x.collect())) for x in (D.search(q, v, 5), D.approximate(q, v, 5, lists=8, probes=8, sample=50))]
    assert both[0] == both[1]
    assert D.approximate(q, v.limit(0), 5, lists=8, probes=2).count() == 0


def test_aliases(spark, tmp_path):
    at = lambda x: [math.cos(x), math.sin(x)]
    rows = [(1, 5, at(0.0)), (2, 3, at(0.2)), (3, 3, at(0.4)), (4, 0, at(2.0)), (5, 1, at(4.0)), (6, 0, at(4.0)), (7, 0, at(4.0))]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = plans.queries()["b18_query_aliases"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, 2), (2, 2), (3, 2), (4, 4), (5, 6), (6, 6), (7, 6)]  # 1, 2, 3 are a chain


def test_sections(spark):
    texts = ["a\nb", "lead\n\n== Cast ==\nx\n==Plot==\n p1\n=== Act ===\np2\n== End ==\ny", "l\n=== Synopsis ===\ns\n=== Next ===\nn", "== plot summary ==\nend", "", None, "a = b\n== C ==\nplot"]
    x = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", T.lead(F.col("x")), T.section(F.col("x"), ("plot", "synopsis", "plot summary")))
    assert [tuple(r)[1:] for r in sorted(x.collect())] == [("a\nb", ""), ("lead", "p1\n=== Act ===\np2"), ("l", "s"), ("", "end"), ("", ""), (None, None), ("a = b", "")]


def test_keyword_candidates_come_first(spark):
    run = lambda rows: spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(rows)], "query_id long, doc_id long, rank int")
    titles = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "b")], "doc_id long, title string")
    got = U.keyword_first(run([5, 4]), run([1, 2, 3, 4]), titles).orderBy("rank").collect()
    assert [tuple(r)[1:] for r in got] == [(5, 0, 1), (4, 0, 2), (1, 1, 3)]


def test_thresholds_need_strict_improvement(spark):
    rows = [("a", 0.9, 1.0, 0.0), ("a", 0.1, 0.0, 1.0), ("b", 0.9, 0.5, 0.5), ("b", 0.2, 0.0, 0.5)]
    sweep = analysis.swept(spark.createDataFrame(rows, "k string, top double, ra double, rb double"), ["k"])
    assert sorted(map(tuple, analysis.chosen(sweep, ["k"]).collect())) == [("a", 0.15), ("b", None)]


def test_leave_one_out(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=40)
    y = 2 * x + r.normal(size=40)
    got = S.leave_one_out(spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double")).first()
    errors = []
    for i in range(40):
        keep = np.arange(40) != i
        slope, intercept = np.polyfit(x[keep], y[keep], 1)
        errors.append(y[i] - slope * x[i] - intercept)
    assert got["loo_rmse"] == pytest.approx(np.sqrt(np.mean(np.square(errors))))
    assert got["loo_r2"] == pytest.approx(1 - np.sum(np.square(errors)) / np.sum((y - y.mean()) ** 2))


def draws(spark, ids, seed, n=1000):
    """The hashes of (seed, id, draw), which fix each resample, as a matrix by id and draw."""
    x = spark.createDataFrame([(i,) for i in ids], "id long").select("id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    at, out = {i: k for k, i in enumerate(ids)}, np.zeros((len(ids), n))
    for i, d, h in x.select("id", "draw", F.hash(F.lit(seed), "id", "draw")).collect():
        out[at[i], d] = h
    return out


def resampled(spark, delta, seed):
    ids = sorted(delta)
    u = np.abs(draws(spark, ids, seed)) / 2**31
    limits = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(5)])  # of a Poisson variable of mean 1
    w = np.searchsorted(limits, u, side="right")
    return (w * np.array([[delta[i]] for i in ids])).sum(axis=0) / w.sum(axis=0)


@pytest.fixture(scope="module")
def delta(spark, sf):
    return {r["id"]: r["delta"] for r in analysis.deltas(registry.Tables(spark, sf)).collect()}


def test_bootstraps_and_permutations_against_numpy(spark, sf, delta):
    run = lambda n: plans.queries()[n](spark, sf).first()
    means, got = resampled(spark, delta, 7), run("s3_paired_bootstrap")
    want = (*np.percentile(means, [2.5, 97.5]), np.mean(means <= 1e-15), np.mean(list(delta.values())))
    assert (got["low"], got["high"], got["p"], got["point"]) == pytest.approx(want, abs=2e-3)
    one, two = ({i: d for i, d in delta.items() if (i % 40 == 0) == c} for c in (True, False))
    diff, got = resampled(spark, one, 11) - resampled(spark, two, 11), run("s4_did_bootstrap")
    assert (got["low"], got["high"]) == pytest.approx(tuple(np.percentile(diff, [2.5, 97.5])), abs=2e-3)
    ids = sorted(delta)
    signs = np.where(draws(spark, ids, 5) % 2 == 0, 1, -1)
    flipped = (signs * np.array([[delta[i]] for i in ids])).mean(axis=0)
    p = np.mean(np.abs(flipped) >= abs(np.mean(list(delta.values()))) - 1e-12)
    assert run("s5_permutation")["p"] == pytest.approx(p, abs=5e-3)


def test_a_weighted_sample_has_the_smallest_keys(spark, sf):
    every = analysis.coherent(registry.Tables(spark, sf), 0, "w").select("query_id", "w", F.hash(F.lit(3), "query_id").alias("h")).collect()
    keys = {r["query_id"]: -math.log((abs(r["h"]) + 1) / 2147483649.0) / max(r["w"], 1e-6) for r in every}
    got = plans.queries()["b13_weighted_sample"](spark, sf).collect()
    assert [r["query_id"] for r in got] == sorted(keys, key=keys.get)[:10]
    assert [r["key"] for r in got] == pytest.approx(sorted(keys.values())[:10])


def test_models_beat_the_commonest_answer(spark, sf):
    x = [r for r in plans.queries()["l6_logistic_labels"](spark, sf).collect() if r["vec_id"] % 5]
    labels = [r["label"] for r in x]
    assert sum(r["found"] == r["label"] for r in x) > 1.5 * max(map(labels.count, set(labels)))
    x = plans.queries()["g5_learned_router"](spark, sf).collect()
    right = sum(r["label"] == r["prediction"] for r in x)
    assert right >= max(sum(r["label"] == c for r in x) for c in (0.0, 1.0))


def test_matrix(spark, tmp_path):
    m = np.arange(70, dtype=np.float64).reshape(10, 7)
    np.save(tmp_path / "m.npy", m)
    got = io.matrix(spark, str(tmp_path / "m.npy"), rows_per_part=4).orderBy("row_id").collect()
    assert [r["row_id"] for r in got] == list(range(10)) and np.array_equal([r["v"] for r in got], m)
    np.save(tmp_path / "none.npy", m[:0])
    assert io.matrix(spark, str(tmp_path / "none.npy")).count() == 0
    np.save(tmp_path / "flat.npy", m[0])
    with pytest.raises(ValueError, match="dimensions"):
        io.matrix(spark, str(tmp_path / "flat.npy"))


def test_a_signal_stops_a_stream(spark, tmp_path):
    before = signal.getsignal(signal.SIGUSR1)
    q = spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        ledger.stop_on_signal(q, signal.SIGUSR1)
        os.kill(os.getpid(), signal.SIGUSR1)
        assert q.awaitTermination(60) and not q.isActive
    finally:
        signal.signal(signal.SIGUSR1, before)


def test_late_interaction_in_passes(spark, monkeypatch):
    r = random.Random(6)
    v = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)], "doc_id long, v array<double>")
    q = v.where("doc_id % 3 = 0").withColumnRenamed("doc_id", "query_id")
    whole = sorted(map(tuple, max_sim(q, v, 2, 5).collect()))
    monkeypatch.setattr(D, "QUERY_BYTES", 200)
    assert sorted(map(tuple, max_sim(q, v, 2, 5).collect())) == whole and len(whole) == 100
