import hashlib
from collections import Counter

import numpy as np
import pytest

from sieveline.llm import line_dedup as m


def brute(rows, least):
    keys = lambda t: [x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")]
    n = Counter(k for _, t in rows for k in {*keys(t)})
    out = []
    for i, t in rows:
        kept = [x for x, k in zip((t or "").split("\n"), keys(t), strict=True) if not (len(k) >= 1 and n[k] >= least)]
        total = (t or "").count("\n") + 1
        out.append((i, total, total - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("settings", [{}, {"min_docs": 2, "shard_keys": 5, "front_size": 3}])
def test_against_brute_force(odd_docs, odd_rows, settings):
    got = m.report(odd_docs, **settings).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute(odd_rows, settings.get("min_docs", 10))


def test_perfect_hash():
    r = np.random.default_rng(0)
    keys = np.unique(r.integers(0, 2**63, 20_000).astype(np.uint64))
    p = m.PerfectHash.load(m.PerfectHash.build(keys).dump())
    assert sorted(p.index(keys)) == list(range(len(keys)))
    h1 = np.array([5, 5, 9], np.int64)
    x = m.Index.load(m.Index.build(h1, np.array([1, 2, 3], np.int64), np.array([10, 20, 30], np.int64)).dump())
    assert x.count(np.array([5, 5, 9, 9, 4], np.int64), np.array([1, 2, 3, 4, 1], np.int64)).tolist() == [10, 20, 30, 0, 0]


def test_clean(odd_docs, odd_rows, no_docs):
    out = m.clean(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == len(odd_rows)
    texts = {r["doc_id"]: r for r in out.where("doc_id >= 100").collect()}
    assert all("Shared Line" not in r["text"] and r["n_chars"] == len(r["text"]) for r in texts.values())
    assert out.where("doc_id = 0").first()["text"] is None
    assert m.clean(no_docs).count() == m.report(no_docs).count() == 0


def test_columns_of_any_name_are_carried_along(clash_docs, odd_docs):
    out = m.clean(clash_docs)
    assert out.columns == clash_docs.columns
    rows = lambda x, cols: sorted(map(tuple, x.select(*cols).collect()), key=repr)
    assert rows(out, odd_docs.columns) == rows(m.clean(odd_docs), odd_docs.columns)
    own = [c for c in clash_docs.columns if c not in odd_docs.columns]
    assert all({*r[1:]} == {-1 if r[0] is None else r[0]} for r in out.select("doc_id", *own).collect())
