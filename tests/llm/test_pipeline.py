"""The pipeline's stages, each against plain Python on its own input."""

import numpy as np
import pytest

import corpus_pipeline as P
from sieveline.llm import decontaminate, line_dedup, packing, toxicity
from sieveline.llm.common import table

from . import test_decontaminate, test_line_dedup, test_ngram_join


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = table(spark, sf, "documents"), []
    for name, f in P.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        f(spark, docs, sf).write.parquet(path)
        done = spark.read.parquet(path)
        out.append((name, docs, done))
        docs = done
    return out


def test_columns(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.count() <= before.count()


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_toxicity(spark, sf, stages):
    _, before, after = stages[0]
    scores = toxicity.score(before, toxicity.train(before, table(spark, sf, "labels"))).collect()
    assert {r["doc_id"] for r in scores if r["predicted"] == 0} == {d for d, _ in rows(after)}


def test_lines(stages):
    _, before, after = stages[1]
    import hashlib

    want = {d: h for d, _, _, h in test_line_dedup.brute(rows(before), line_dedup.MIN_DOCS)}
    assert {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in rows(after)} == want


def test_near_copies(stages):
    _, before, after = stages[2]
    own = rows(before)
    sets, root = [test_ngram_join.grams(t) for _, t in own], {d: d for d, _ in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and len(a & sets[j]) * 5 >= 4 * len(a | sets[j]):
                x, y = find(own[i][0]), find(own[j][0])
                root[max(x, y)] = min(x, y)
    assert {d for d, _ in rows(after)} == {d for d in root if find(d) == d}


def test_contamination(spark, sf, stages):
    _, before, after = stages[3]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    found = test_decontaminate.brute(rows(before), items)
    assert {d for d, _ in rows(after)} == {x[0] for x in found if not x[-1]}
    assert decontaminate.WINDOW == 13


def test_packing(stages):
    _, before, after = stages[4]
    w = packing.Words(packing.VOCABULARY)
    total = {d: len(w.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in rows(before)}
    got = after.toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == total
    used = got.groupby("sequence_id").length.sum()
    assert used.max() <= 4096 and len(used) <= int(np.ceil(sum(total.values()) / 4096)) + 2


def test_run(spark, sf, stages):
    assert P.run(spark, sf).count() == stages[-1][2].count()


def test_empty(spark, sf):
    docs = table(spark, sf, "documents").where("false")
    for _, f in P.STAGES:
        docs = f(spark, docs, sf)
        assert docs.count() == 0
