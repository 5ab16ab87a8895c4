import hashlib
import re

import pytest

from sieveline.llm import decontaminate as m

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items):
    low = lambda t: WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    wins = [(None if i is None else str(i), w[a : a + 13]) for i, t in items for w in [low(t)] for a in range(max(1, len(w) - 12) if w else 0)]
    out = []
    for doc, t in docs:
        w = low(t)
        hit, ids = set(), set()
        for i, p in wins:
            for a in range(len(w) - len(p) + 1):
                if w[a : a + len(p)] == p:
                    hit.update(range(a, a + len(p)))
                    ids.add(i)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted("null" if i is None else i for i in ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


ITEMS = [(1, "one two"), (2, None), (3, "!!!"), (None, "common tail"), (10, "Common TAIL words"), (10, "common tail"), (4, " ".join("abcdefghijklmnopq"))]


@pytest.fixture(scope="module")
def benchmark(spark, odd_rows):
    passage = next(t for i, t in odd_rows if i == 5)
    return spark.createDataFrame([*ITEMS, (7, passage[100:400])], "item_id long, text string")


@pytest.mark.parametrize("limit", [64 << 20, 3000])
def test_against_brute_force(odd_docs, odd_rows, benchmark, limit):
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = sorted(map(tuple, m.mark(odd_docs, benchmark, limit).select(*cols).collect()), key=repr)
    assert got == brute(odd_rows, [tuple(r) for r in benchmark.collect()])


def test_spans_point_into_the_original(spark):
    docs = spark.createDataFrame([(1, "É — Common, Tail! x")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "common tail")], "item_id long, text string")
    s = m.mark(docs, bench).first()["hit_spans"]
    assert ["É — Common, Tail! x"[a:b] for a, b in s] == ["Common, Tail"]


def test_an_item_without_id_is_not_one_of_that_name(spark):
    docs = spark.createDataFrame([(1, "one two, three four"), (2, "three four")], "doc_id long, text string")
    bench = spark.createDataFrame([("null", "one two"), (None, "three four"), (None, "two three")], "item_id string, text string")
    got = sorted((r["doc_id"], r["n_items"], r["item_ids"]) for r in m.mark(docs, bench).collect())
    assert got == [(1, 2, ["null", "null"]), (2, 1, ["null"])]


@pytest.mark.parametrize("limit", [64 << 20, 3000])
def test_clean_keeps_columns(odd_docs, clash_docs, benchmark, no_docs, spark, limit):
    out = m.clean(odd_docs, benchmark, limit)
    own = m.clean(clash_docs, benchmark, limit)
    assert own.columns == clash_docs.columns and sorted(map(tuple, own.select(*odd_docs.columns).collect()), key=repr) == sorted(map(tuple, out.collect()), key=repr)
    assert out.columns == odd_docs.columns
    marked = m.mark(odd_docs, benchmark)
    assert out.count() == marked.where("NOT contaminated").count()
    none = spark.createDataFrame([], "item_id long, text string")
    assert m.clean(odd_docs, none).count() == odd_docs.count()
    assert m.clean(no_docs, benchmark).count() == m.mark(no_docs, none).count() == 0
