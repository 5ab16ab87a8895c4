import random
from itertools import combinations

import numpy as np
import pytest

from sieveline.llm import ngram_join as m
from sieveline.llm import shingles as S
from sieveline.llm.decontaminate import normal_words


def grams(t):
    w = normal_words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.fixture(scope="module")
def near(spark):
    r = random.Random(5)
    rows = [(1000, None), (1001, ""), (1002, "??"), (1003, "two words"), (1004, "Two, words!"), (None, "two words")]
    for g in range(6):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.choice((6, 30, 90)))]
        for k in range(9):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 18))):
                w[r.randrange(len(w))] = f"v{r.randint(0, 99)}"
            rows.append((g * 100 + k, " ".join(w)))
    rows += rows[8:12]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


@pytest.mark.parametrize("block", [1000, 4, 1])
def test_links_and_classes_against_brute_force(near, block):
    docs, rows = near
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    links = [0] * len(rows)
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            root[max(find(a), find(b))] = min(find(a), find(b))
    heads = {}
    for i, (d, _) in enumerate(rows):
        h = find(i)
        heads[h] = min((x for x in (heads.get(h), d) if x is not None), default=None)
    want = sorted(((d, heads[find(i)], links[i]) for i, (d, _) in enumerate(rows)), key=repr)
    got = m.join(docs, block=block).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=repr) == want
    assert sum(links) > 50


def test_clean_leaves_one_of_each_class(near, odd_docs, no_docs):
    docs, rows = near
    got = m.join(docs).toPandas()
    wordless = sum(not grams(t) for _, t in rows)
    classes = got[got.n_equal > 0].class_id.nunique()
    assert m.clean(docs).count() == classes - 3 + wordless  # 1000, 1001 and 1002 are classes of their own
    out = m.clean(odd_docs)
    assert out.columns == odd_docs.columns and out.count() < odd_docs.count()
    assert m.clean(no_docs).count() == 0


def test_bands_meet_the_recall():
    bands = m.plan_bands(0.8, 0.9999, 6)
    assert 1 - (1 - 0.8**6) ** bands >= 0.9999 > 1 - (1 - 0.8**6) ** (bands - 1)


def test_shingles_match_tuples():
    r = random.Random(2)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 12))).encode() for _ in range(200)]
    h, after = S.sets(*S.shingle_hashes(texts))
    assert [b - a for a, b in zip(after[:-1], after[1:], strict=True)] == [len(grams(t)) for t in texts]
    for i, j in combinations(range(0, 200, 9), 2):
        own, other = (h[after[k] : after[k + 1]] for k in (i, j))
        assert len(np.intersect1d(own, other)) == len(grams(texts[i]) & grams(texts[j]))


def test_columns_of_any_name_are_carried_along(clash_docs, odd_docs):
    out = m.clean(clash_docs)
    assert out.columns == clash_docs.columns
    rows = lambda x: sorted(map(tuple, x.select("doc_id", "text").collect()), key=repr)
    assert rows(out) == rows(m.clean(odd_docs))
    own = [c for c in clash_docs.columns if c not in odd_docs.columns]
    assert all({*r[1:]} == {-1 if r[0] is None else r[0]} for r in out.select("doc_id", *own).collect())


def test_a_chain_is_verified_key_by_key_and_a_group_as_a_whole(spark, tmp_path):
    """A loose chain goes by its keys, near copies by their component; either way links are exact."""
    r = random.Random(8)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(4000)]
    chain = [" ".join(words[i * 14 : i * 14 + 60]) for i in range(240)]
    base = [f"b{r.randint(0, 10**6)}" for _ in range(90)]
    group = []
    for _ in range(40):
        w = list(base)
        w[r.randrange(90)] = f"v{r.randint(0, 99)}"
        group.append(" ".join(w))
    texts = chain + group + [" ".join(words[i * 14 + 1 : i * 14 + 60]) for i in range(0, 240, 7)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [grams(t) for t in texts]
    want = [sum(5 * len(a & b) >= 4 * len(a | b) for b in sets) - 1 for a in sets]
    scratch = m.Scratch(spark, "test")
    own = docs.select("doc_id", m.F.xxhash64("text").alias("th"), m.F.col("text").cast("binary").alias("text"))
    signs = m.signed(own, 5, m.plan_bands(), m.ROWS).withColumnRenamed("doc_id", "node")
    units = m._units(signs, scratch, 8).collect()
    kinds = {i: {u["band"] for u in units if u["node"] == i} for i in range(len(texts))}
    assert any(-1 not in kinds[i] and kinds[i] for i in range(240)) and all(kinds[i] == {-1} for i in range(240, 280))
    got = {x["doc_id"]: x["n_links"] for x in m.join(docs, block=8).collect()}
    assert [got[i] for i in range(len(texts))] == want and sum(want) > 200


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_measured_recall_of_the_bands(similarity):
    """Pairs of sets at exactly this similarity share a key as often as planned."""
    r, pairs = np.random.default_rng(4), 3000
    both, each = round(120 * similarity), 60 - round(60 * similarity)
    fresh = r.integers(0, 2**63, (pairs, both + 2 * each)).astype(np.uint64)
    x = np.concatenate((fresh[:, : both + each], np.concatenate((fresh[:, :both], fresh[:, both + each :]), axis=1))).ravel()
    keys = m.band_keys(x, np.arange(2 * pairs + 1) * (both + each), m.plan_bands(), m.ROWS)
    assert both / (both + 2 * each) == pytest.approx(similarity)
    assert (keys[:pairs] == keys[pairs:]).any(axis=1).mean() >= 0.999
