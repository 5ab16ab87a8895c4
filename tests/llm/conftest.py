import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties and repeated rows, columns that operators use themselves."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    passage = " ".join(word() for _ in range(120))
    long = " ".join(word() for _ in range(30_000))
    texts = [None, "", "...", "one two", "Ünïcode É ok.\n\nx", passage, passage, "Intro words here. " + passage + " and a tail of its own", long, long[:5000] + " " + passage, "a\r\n b \nB\n" * 40, "aa" * 900]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t), "k", 1) for i, t in enumerate(texts)]
    rows += [(5, passage, None, None, None, None, None), (None, passage, "en", "s", 1, "k", 1), (None, None, None, None, None, None, None)]
    rows += [(100 + i, f"row {i} {word()} common tail words follow\nShared Line Of Text\n{word()} {word()}", "en", "s0", 1, "k", i) for i in range(14)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_rows(odd_docs):
    return [(r["doc_id"], r["text"]) for r in odd_docs.collect()]


@pytest.fixture(scope="session")
def clash_docs(odd_docs):
    """The odd rows beside columns that have the names operators use for their own."""
    from pyspark.sql import functions as F

    names = "TH own_id Own_Th number id lines lines_to_drop n1 n2 node keys spans place part unit band __th __hash __id __drop __n".split()
    return odd_docs.select("*", *(F.coalesce("doc_id", F.lit(-1)).alias(c) for c in names))
