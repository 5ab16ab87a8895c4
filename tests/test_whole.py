"""Queries that do the whole job, against brute force on small tables that a cut would change."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from sieveline import plans
from sieveline.operators import dense as D


def at(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_l2_takes_all_languages_and_bigrams(spark, tmp_path):
    texts = ["red fox runs far", "red fox sleeps", "fox red den", "der rote Fuchs runs far", "", "common red word", "el zorro rojo", "zorro rojo el", "common fox", None, "x y red fox runs"]
    rows = [(20 * i if i % 2 else 20 * i + 1, t, "es" if i == 6 else "en") for i, t in enumerate(texts)]
    tokens = {d: re.findall("[a-z0-9]{2,}", (t or "").lower()) for d, t, _ in rows}
    terms = {d: Counter(k + [" ".join(p) for p in zip(k, k[1:], strict=False)]) for d, k in tokens.items()}
    df = Counter(x for c in terms.values() for x in c)
    w = {d: {x: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[x])) + 1) for x, n in c.items() if 2 <= df[x] <= len(rows) / 2} for d, c in terms.items()}
    unit = {d: {x: v / math.sqrt(sum(y * y for y in c.values())) for x, v in c.items()} for d, c in w.items()}
    want = set()
    for q in (d for d in unit if d % 20 == 0):
        scores = [(-round(sum(v * unit[d].get(x, 0) for x, v in unit[q].items()), 5), d) for d in unit if d != q and set(unit[q]) & set(unit[d])]
        want |= {(q, d, -s) for s, d in sorted(scores)[:5]}
    got = plans.queries()["l2_tfidf_catalogue"](spark, at(spark, tmp_path, documents=(rows, "doc_id long, text string, lang string"))).collect()
    assert {(r["query_id"], r["doc_id"], r["score"]) for r in got} == want and len(got) == len(want) > 5


def components(edges):
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("small", (False, True))
def test_j10_finds_every_link(spark, tmp_path, monkeypatch, small):
    if small:  # several passes and blocks
        monkeypatch.setattr(D, "QUERY_BYTES", 600)
        monkeypatch.setattr(D, "SIDE", 3)
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(30)]
    rows += [(101 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(25)]  # more copies than 16, most ids not divisible by 20
    rows += [(200 + i, [math.cos(i / 5), math.sin(i / 5), 0.0, 0.0]) for i in range(12)]  # a chain
    rows += [(300, [0.0] * 4)]
    unit = {i: [x / (math.hypot(*v) or 1) for x in v] for i, v in rows}
    links = [(a, b) for a in unit for b in unit if a != b and round(sum(x * y for x, y in zip(unit[a], unit[b], strict=True)), 6) >= 0.97]
    root, n = components(links), Counter(a for a, _ in links)
    got = plans.queries()["j10_near_classes"](spark, at(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<double>"))).collect()
    assert n[101] >= 24 and sorted(map(tuple, got)) == sorted((i, root.get(i, i), n[i]) for i in unit)


def test_a26_and_a27_keep_parts_apart(spark, tmp_path):
    keys = [1, 10, 401, 2, 802, 73, 500, 3503]  # 1 and 401, 2 and 802 are the same modulo 400
    folder = at(spark, tmp_path, part=([(k, 11 + i) for i, k in enumerate(keys)], "p_partkey long, p_size int"))
    root = components([(k, 7 * k + 3) for k in keys])
    got = plans.queries()["a26_part_components"](spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted(root.items()) and root[1] != root[401]
    classes = {r: [n for n in root if root[n] == r] for r in root.values()}
    best = lambda c: f"key {min(c, key=lambda n: (n % 2, len(str(n)), n))}"
    got = plans.queries()["a27_part_canonical"](spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted((r, len(c), best(c)) for r, c in classes.items())


def test_co_rated_items_are_not_folded(spark, tmp_path):
    r = random.Random(9)
    rated = {(u, m) for u in range(12) for m in r.sample([1, 201, 401, 2, 202, 3], 5)} | {(u, 1000 + 200 * i) for u in range(6) for i in range(60)}
    lines = [(u, m, q) for u, m in rated for q in (40, 35)] + [(u, 5, 34) for u in range(12)]
    folder = at(spark, tmp_path, orders=([(u, u % 12) for u in range(12)], "o_orderkey long, o_custkey long"), lineitem=(lines, "l_orderkey long, l_partkey long, l_quantity int"))
    n = Counter((a, b) for u, a in rated for v, b in rated if u == v and a != b)
    top = {a: sorted((-c, y) for (x, y), c in n.items() if x == a)[:50] for a, _ in n}
    kept = {a: [(b, -c) for c, b in t if -c >= 5] for a, t in top.items()}
    run = lambda name: sorted(map(tuple, plans.queries()[name](spark, folder).collect()))
    assert run("a10_item_cooccurrence") == sorted((a, b, c) for a, t in kept.items() for b, c in t)
    assert run("b4_item_bags") == sorted((a, len(t), ",".join(str(b) for b, _ in t)) for a, t in kept.items() if len(t) >= 2)
    assert run("j8_item_pairs") == [(sum(n.values()),) * 2]


def test_p6_and_p1_show_a_change_behind_the_prefix(spark, tmp_path):
    texts = ["word " * 40 + tail for tail in ("abc", "abd")]
    folder = at(spark, tmp_path, pages=([(i, f"<p>{x}</p>") for i, x in enumerate(texts)], "page_id long, html string"), documents=(list(enumerate(texts)), "doc_id long, text string"))
    for name in ("p6_strip_tags_whole", "p1_tokens_whole"):
        assert {r["hash"] for r in plans.queries()[name](spark, folder).collect()} == {hashlib.md5(x.encode()).hexdigest() for x in texts}
