"""Searches by scans of the texts, against brute force, in one pass and several, and without a join of postings."""

import math
import random
import re
from collections import Counter

import pytest

from sieveline import plans
from sieveline.functions.text import STOP_WORDS
from sieveline.operators import dense as D
from sieveline.operators import scan as C


def content(text):
    return [t for t in re.findall("[a-z0-9]{2,}", (text or "").lower()) if t not in STOP_WORDS]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["the", "of"]
    made = lambda n: " ".join(r.choices(words, range(42, 0, -1), k=n))
    documents = [(i, made(r.randint(0, 60))) for i in range(150)] + [(200 + i, "w1 w2 w2 w39") for i in range(20)] + [(300, None), (301, "")]
    return documents, [(i, made(r.randint(1, 9))) for i in range(12)] + [(20, "the of"), (21, None), (22, "unseen w3 w3")]


@pytest.fixture
def folder(spark, tmp_path, texts):
    for name, rows, key in (("documents", texts[0], "doc_id"), ("benchmark", texts[1], "item_id")):
        spark.createDataFrame(rows, f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def half_up(x, digits=6):
    return math.floor(x * 10**digits + 0.5) / 10**digits


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(params=(False, True))
def small(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(D, "QUERY_BYTES", 600)
        monkeypatch.setattr(C, "CELLS", 30)


def test_p25_by_one_scan(spark, folder, texts, small):
    df = plans.queries()["p25_lexical_overlap"](spark, folder)
    want = []
    for q, text in texts[1]:
        a, found = set(content(text)), []
        for d, other in texts[0]:
            b = set(content(other))
            if a & b:
                found.append((-half_up(len(a & b) / len(a)), d, half_up(len(a & b) / len(a | b))))
        want += [(q, d, -c, j) for c, d, j in sorted(found)[:5]]
    assert sorted((r["query_id"], r["doc_id"], r["coverage"], r["jaccard"]) for r in df.collect()) == sorted(want)
    assert "Join" not in planned(df)


def test_r3_by_scans(spark, folder, texts, small):
    df = plans.queries()["r3_bm25_param_sweep"](spark, folder)
    docs = {d: content(text) for d, text in texts[0]}
    n, avgdl = len(docs), sum(map(len, docs.values())) / sum(text is not None for _, text in texts[0])
    tf = {d: Counter(k) for d, k in docs.items()}
    df_of = Counter(x for c in tf.values() for x in c)
    want = {}
    for k1 in (0.3, 0.9, 1.5):
        for b in (0.4, 0.75):
            tops, firsts = [], []
            for _, text in texts[1]:
                terms = set(content(text))
                score = {d: half_up(sum(math.log(1 + (n - df_of[x] + 0.5) / (df_of[x] + 0.5)) * c[x] / (c[x] + k1 * (1 - b + b * len(docs[d]) / avgdl)) for x in sorted(terms) if x in c)) for d, c in tf.items() if terms & set(c)}
                best = [s for s, _ in sorted(((s, d) for d, s in score.items()), key=lambda x: (-x[0], x[1]))[:10]]
                tops, firsts = tops + best, firsts + best[:1]
            want[k1, b] = (len(tops), sum(tops) / len(tops), sum(firsts) / len(firsts))
    got = {(r["k1"], r["b"]): (r["n_hits"], r["mean_score"], r["mean_top"]) for r in df.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=6e-5) for k in want)
    assert "Join" not in planned(df)
