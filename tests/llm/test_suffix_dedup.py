import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sieveline.llm import suffix_dedup as m


def brute(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    n = Counter(b[i : i + length] for b in raws for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, raws, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), len(m.runs(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("settings", [{}, {"hot": 0}, {"block_bytes": 2000}])
def test_against_brute_force(odd_docs, odd_rows, settings):
    rows = [(d, t) for d, t in odd_rows if len(t or "") < 50_000]
    docs = odd_docs.where("text IS NULL OR length(text) < 50000")
    got = m.dedup(docs, **settings).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = brute(rows, 400)
    assert sorted(map(tuple, got), key=repr) == want
    assert sum(x[2] for x in want) > 3000


def test_long_and_empty(odd_docs, no_docs):
    assert m.dedup(odd_docs).where("doc_id = 8").first()["n_removed"] > 4000
    assert m.dedup(no_docs).count() == 0


def test_equal_strings_have_equal_anchors():
    r = random.Random(1)
    for turn in range(40):
        raw = bytes(r.choice(b"ab" if turn % 2 else b"abcdefghij") for _ in range(r.randint(30, 300)))
        raw = (raw[:7] * 60)[:300] if turn % 3 == 0 else raw
        key, place, first, last = m.window_anchors(raw, 20, 8)
        assert first[0] == 0 and last[-1] == len(raw) - 20 and (first[1:] == last[:-1] + 1).all()
        seen = {}
        for k, p, a, b in zip(key, place, first, last, strict=True):
            for i in range(a, b + 1):
                assert i <= p <= i + 12 and seen.setdefault(raw[i : i + 20], (k, p - i)) == (k, p - i)


def test_cover_sort_in_blocks():
    r = random.Random(2)
    base = bytes(r.choice(b"abcd") for _ in range(900))
    contexts, buckets = [], []
    for _ in range(14):
        a = r.randint(0, 300)
        x = bytearray(base[a : a + r.randint(400, 600)])
        if r.random() < 0.6:
            x[r.randrange(len(x))] = 120
        contexts.append(bytes(x))
        buckets.append(r.randint(0, 1))
    n = Counter((b, c[i : i + 400]) for c, b in zip(contexts, buckets, strict=True) for i in range(len(c) - 399))
    want = [[n[b, c[i : i + 400]] > 1 for i in range(len(c) - 399)] for c, b in zip(contexts, buckets, strict=True)]
    assert [f.tolist() for f in m.repeated(contexts, np.array(buckets), 400)] == want


def test_every_distance_is_covered():
    assert {(a - b) % m.PERIOD for a in m.COVER for b in m.COVER} == set(range(m.PERIOD))
