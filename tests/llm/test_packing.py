import random
import zlib

import numpy as np

from sieveline.llm import packing as m

ODD = ["", " ", "a.b,c..d", "İstanbul ΣΑΣ. naïve, don't it's 3.5,7 x²,½. é.", " a b\u0085c", "中文。字,", "a<|endoftext|>b", "it's,", "ǅ., Ⅷ. ٣,", "\x1c a\x1fb", "THE.' the's, re's. IT'S é, a_b_ __ 'd 'D", "Åb.,;' K, ſt! ßS."]


def whole(words, text):
    return np.array(words.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_words_give_the_ids_of_whole_texts(spark):
    w = m.Words(m.VOCABULARY)
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ODD
    for _ in range(2):  # cold and warm
        assert w.encode(texts) == [whole(w, t) for t in texts]


def test_place_is_valid_and_tight():
    r = random.Random(4)
    lengths = np.array(sorted((min(4096, int(r.expovariate(1 / 600)) + 1) for _ in range(4000)), reverse=True))
    sequence, offset = m.place(lengths)
    for s in range(sequence.max() + 1):
        own = np.argsort(offset[sequence == s])
        n, at = lengths[sequence == s][own], offset[sequence == s][own]
        assert (at == np.concatenate(([0], np.cumsum(n)[:-1]))).all() and n.sum() <= 4096
    assert sequence.max() + 1 <= -(-lengths.sum() // 4096) + 1


def test_smallest_sum_of_squares_is_chosen():
    r = random.Random(7)
    for _ in range(60):
        lengths = [r.randint(1, 30) for _ in range(25)]
        sequence, _ = m.place(np.array(lengths), size=40)
        gaps = []
        for n, s in zip(lengths, sequence, strict=True):
            squares = lambda g: sum(g.count(x) ** 2 for x in {*g} if x)
            ways = [squares([*gaps[:i], g - n, *gaps[i + 1 :]]) for i, g in enumerate(gaps) if g >= n]
            if s == len(gaps):
                assert not ways  # a new sequence only if none has room
                gaps.append(40 - n)
            else:
                gaps[s] -= n
                assert gaps[s] >= 0 and squares(gaps) == min(ways)


def test_column(odd_docs, odd_rows, no_docs):
    got = m.pack(odd_docs, per_shard=7).collect()
    w = m.Words(m.VOCABULARY)
    want = []
    for d, t in odd_rows:
        ids = whole(w, t or "") + np.array([1], "<u4").tobytes()
        want += [(d, k, a // 4, len(ids[a : a + 4 * 4096]) // 4, zlib.crc32(ids[a : a + 4 * 4096])) for k, a in enumerate(range(0, len(ids), 4 * 4096))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 4096
    assert m.pack(no_docs).count() == 0


def test_sequences_hold_the_ids(odd_docs):
    placed = m.pack(odd_docs)
    out = {r["sequence_id"]: r["ids"] for r in m.sequences(odd_docs, placed).collect()}
    for r in placed.collect():
        own = np.array(out[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]], "<u4").tobytes()
        assert zlib.crc32(own) == r["ids_crc32"]
