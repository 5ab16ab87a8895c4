"""Hand examples of scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from sieveline.functions import text as T
from sieveline.functions import vector as V
from sieveline.operators import lexical as L


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], [f"c{i}" for i in range(len(values))])
    return df.select(f(*(F.col(c) for c in df.columns)).alias("x")).first()["x"]


CASES = [
    (T.query_tokens, ("usb c cable",), ["usb", "cable"]),
    (T.query_tokens, ("iPhone 12 Case",), ["iphone", "12", "case"]),
    (T.query_tokens, ("",), []),
    (T.tokens, ("usb c cable",), ["usb", "c", "cable"]),
    (T.slugify, ("Hello, World -- 2!",), "hello-world-2"),
    (T.strip_html, ("&lt;b&gt;a&lt;/b&gt; &amp;lt; <i>c</i>  d",), "a &lt; c d"),
    (T.duration, (45,), "45s"),
    (T.duration, (125,), "2m 05s"),
    (T.duration, (3725,), "1h 02m"),
    (T.normalize_title, ("Engineer (m/f) - Remote",), "engineer"),
    (T.normalize_title, ("Cook - Paris, France",), "cook - paris, france"),
    (T.skeleton, ("bookkeeper",), "bkpr"),
    (T.verdict, ("blah\nverdict: Related",), "RELATED"),
    (T.verdict, ("nothing",), "UNCERTAIN"),
    (T.negated, ("shoes without laces, gluten-free",), ["laces", "gluten"]),
    (T.inversion_cause, ("phone without camera",), "negation"),
    (T.inversion_cause, ("model x200",), "model_number"),
    (T.capped_distance, ("abc", "abcdefgh"), 4),
    (T.capped_distance, ("kitten", "sitting"), 3),
]


@pytest.mark.parametrize(("f", "given", "want"), CASES)
def test_examples(spark, f, given, want):
    assert one(spark, f, *given) == want


@pytest.mark.parametrize(("d", "want"), [(0.0, 1.0), (2.0, 0.0), (4.0, -1.0), (0.5, 0.75)])
def test_l2_to_cosine(spark, d, want):
    assert one(spark, T.l2_to_cosine, d) == want


def test_salary(spark):
    s = one(spark, T.salary, "$1,200 - 1,500 a month")
    assert (s["low"], s["high"], s["currency"]) == (1200, 1500, "USD")
    assert one(spark, T.salary, "negotiable")["low"] is None


def test_enrich(spark):
    assert one(spark, T.enrich, "Lamp", "", "lamp", "Desk") == "Lamp — Desk"


def test_vectors(spark):
    a, b = [3.0, 4.0], [4.0, 3.0]
    assert one(spark, V.dot, a, b) == 24 and one(spark, V.norm, a) == 5
    assert one(spark, V.unit, [0.0, 0.0]) is None and one(spark, V.unit, a) == [0.6, 0.8]


def test_sums_give_spread_and_coherence(spark):
    r = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    s = V.sums(spark.createDataFrame(r, "g int, v array<double>"), ["g"])
    got = {x["g"]: x for x in s.select("g", V.specificity(F.col("total"), F.col("n")).alias("s"), V.coherence(F.col("total"), F.col("n")).alias("c")).collect()}
    assert got[1]["s"] == pytest.approx(math.sqrt(5) / 3) and got[1]["c"] == pytest.approx(1 / 3)
    assert got[2]["s"] == 1 and got[2]["c"] == 0


def test_combos(spark):
    got = one(spark, L.combos, ["hp", "laptop", "ram"])
    assert len(got) == 7 and ["hp", "laptop", "ram"] in [x["words"] for x in got]
