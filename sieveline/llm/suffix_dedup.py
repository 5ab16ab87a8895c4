"""Removal of bytes under repeated 400-byte strings, by suffix sorting with a difference cover.

Every byte that a string of `length` bytes covers which also starts anywhere else goes.

1. Buckets. A suffix's bucket is given by the smallest hash among the `key_bytes`-grams of
   its first `length` bytes (the leftmost of equal ones): equal strings have equal keys at
   equal places. Consecutive suffixes mostly share their anchor, so a document gives one
   row per anchor: its key, the run of suffixes it stands for, and a hash of the bytes
   these cover (the context). Only keys that occur at least twice go on.
2. Equal contexts. Rows with equal key and context are counted. If there are two or more,
   all their suffixes repeat, however many copies there are, and no text travels for them.
3. Sorting. Keys with several contexts of which some stand alone need a look at the bytes;
   one context of each kind travels to the block of its key. A block of bounded size is
   sorted in a task, one suffix bucket at a time: a difference cover modulo 7 gives sample
   positions, whose strings of 392 bytes are ranked first (by doubling). Suffixes that
   agree in their first and last 8 bytes are told apart by the ranks of two cover samples
   that lie equally far from both: so no comparison reads on through a long tie.
4. A key of more than `hot` contexts is not sorted in one task: its suffixes are named by
   128-bit hashes of their strings, and names are counted.
5. Runs of repeated suffixes are united by document, and the bytes they cover removed.

Filters of fixed size (bitmaps, at most `BITMAP` bits) spare the shuffle rows that cannot
match; what passes them is still joined exactly. Keys and context hashes only choose what
is compared or counted; contexts are equal if 128 bits are.

Null and empty texts count as empty: nothing is removed. Texts under `length` bytes have
no such string. Rows alike in doc_id and text repeat each other, so all of a text of at
least `length` bytes goes from either. Null doc_ids are kept. An empty table gives an
empty result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches, text_bytes
from .shingles import mix

LENGTH, KEY_BYTES = 400, 200
#: Contexts of a key beyond which its suffixes are named by hashes; bytes of contexts in a block.
HOT, BLOCK_BYTES = 1000, 2 << 20
#: Bits of a filter per element, and at most.
FILTER, BITMAP = 16, 1 << 28
#: Of the rolling hash, modulo 2 ** 64.
BASE, INVERSE = np.uint64(0x100000001B3), np.uint64(pow(0x100000001B3, -1, 2**64))
#: A difference cover: every residue modulo 7 is a difference of two of these.
PERIOD, COVER = 7, (0, 1, 3)


def window_anchors(raw: bytes, length: int, key_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, first, last): anchors and the run of suffixes that each stands for."""
    n, w = len(raw), length - key_bytes + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none.view(np.uint64), none, none, none
    powers, inverse = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, b)))) for b in (BASE, INVERSE))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * powers[:n])))
    h = mix((sums[key_bytes:] - sums[:-key_bytes]) * inverse[: n - key_bytes + 1])
    # The leftmost smallest of each w consecutive hashes: prefix and suffix minima of blocks of w.
    m = len(h)
    blocks = np.concatenate((h, np.full(-m % w, np.uint64(2**64 - 1)))).reshape(-1, w)
    fore, back = np.minimum.accumulate(blocks, axis=1).ravel(), np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: m - w + 1], fore[w - 1 : m])
    change = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    # A run of one value may go on to a second equal hash when the first leaves the window.
    first, key, place = [], [], []
    ends = np.append(change[1:], len(least))
    at = np.flatnonzero(np.isin(h, least[change])) if len(change) else none
    by_value = np.lexsort((at, h[at]))
    sorted_at, sorted_h = at[by_value], h[at][by_value]
    lo = np.searchsorted(sorted_h, least[change], "left")
    hi = np.searchsorted(sorted_h, least[change], "right")
    simple = hi - lo == 1
    for a, b, i, j, s in zip(change.tolist(), ends.tolist(), lo.tolist(), hi.tolist(), simple.tolist(), strict=True):
        if s:
            first.append(a)
            place.append(int(sorted_at[i]))
        else:
            own = sorted_at[i:j]
            k = int(np.searchsorted(own, a))
            while a < b:
                p = int(own[k])
                first.append(a)
                place.append(p)
                a, k = p + 1, k + 1
    first, place = np.array(first, np.int64), np.array(place, np.int64)
    return h[place], place, first, np.append(first[1:], len(least)) - 1


def filter_bits(count: int) -> int:
    return min(BITMAP, max(1 << 15, 1 << (FILTER * max(1, count) - 1).bit_length()))


def bitmap(values: DataFrame, column: str, count: int) -> np.ndarray:
    """One bit per hash value, by `filter_bits(count)`; at most BITMAP / 8 bytes come to the driver."""
    bits = filter_bits(count)
    at = F.pmod(F.col(column), F.lit(bits))
    rows = values.select((at / 32768).cast("long").alias("bucket"), (at % 32768).cast("long").alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r["bucket"] * 4096 : r["bucket"] * 4096 + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def passes(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = x.astype(np.int64) % np.int64(len(bits) * 8)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _keys(texts: DataFrame, length: int, key_bytes: int) -> DataFrame:
    """Keys with the number of their anchors, summed within batches."""

    def batch(rows: dict) -> dict:
        found = [window_anchors(x, length, key_bytes)[0] for x in rows["text"]]
        key, n = np.unique(np.concatenate(found), return_counts=True)
        return {"key": key.view(np.int64), "n": n}

    return map_batches(texts.select("text"), batch, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


ANCHORS = "key long, c1 long, c2 long, doc_id long, th long, place int, first int, last int"


def _anchors(texts: DataFrame, length: int, key_bytes: int, bits) -> DataFrame:
    """Anchors whose keys pass the filter, with a hash of their context."""

    def batch(rows: dict) -> dict:
        out: dict = {c.split(" ")[0]: [] for c in ANCHORS.split(", ")}
        for doc_id, th, raw in zip(rows["doc_id"], rows["th"], rows["text"], strict=True):
            key, place, first, last = window_anchors(raw, length, key_bytes)
            own = np.flatnonzero(passes(key.view(np.int64), bits.value)) if len(key) else ()
            for k, p, a, b in zip(key.view(np.int64)[own].tolist(), place[own].tolist(), first[own].tolist(), last[own].tolist(), strict=True) if len(own) else ():
                c = xxhash.xxh3_128_digest(raw[a : b + length], seed=p - a)
                for name, v in zip(out, (k, int.from_bytes(c[:8], "little", signed=True), int.from_bytes(c[8:], "little", signed=True), doc_id, th, p, a, b), strict=True):
                    out[name].append(v)
        return out

    return map_batches(texts, batch, ANCHORS)


def _word(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as one number that sorts like them."""
    view = np.lib.stride_tricks.as_strided(x, (len(x) - 7, 8), (1, 1))
    return view[at].copy().view(">u8").ravel().astype(np.uint64)


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples of keys, in their order."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def cover_ranks(x: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """Ranks of the strings at the cover's sample positions, by place (-1 elsewhere), and their length.

    x is padded, so that all strings lie inside. Doubling keeps to multiples of the period,
    so a sample's second half starts at a sample again.
    """
    n = len(x) - length - 8
    at = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    goal = (length - PERIOD) // PERIOD * PERIOD  # what a sample within a period of a suffix's start can cover
    goal -= PERIOD * (goal + PERIOD - 1 > length)
    rank = np.full(len(x), -1, np.int64)
    rank[at] = _rank(_word(x, at) >> np.uint64(8))  # 7 bytes
    size = PERIOD
    while size < goal:
        step = min(size, goal - size)
        rank[at] = _rank(rank[at], rank[at + step])
        size += step
    return rank, size


def _distance() -> np.ndarray:
    """By residues of two places: how far from both lie two cover samples."""
    return np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])


def repeated(contexts: list[bytes], buckets: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context, which of its suffixes of `length` bytes or more repeat within its bucket.

    The contexts of a block are laid end to end; its cover samples are ranked once, and then
    each suffix bucket is settled: suffixes alike at both ends are matched by sample ranks.
    """
    pad = bytes(length + 16)
    x = np.frombuffer(b"".join(contexts) + pad, np.uint8)
    sizes = np.array([len(c) for c in contexts])
    begins = np.cumsum(sizes) - sizes
    count = sizes - length + 1
    at = np.repeat(begins - (np.cumsum(count) - count), count) + np.arange(count.sum())
    rank, reach = cover_ranks(x, length)
    # Behind the sample's string at most PERIOD bytes remain, and before it fewer: both lie in these.
    tie = _rank(np.repeat(buckets, count), _word(x, at), _word(x, at + length - 8))
    dup = np.zeros(len(at), bool)
    alone = np.bincount(tie) == 1
    open_ = np.flatnonzero(~alone[tie])
    residue, distance = at % PERIOD, _distance()
    ranks = int(rank.max()) + 2
    by_residue = [open_[residue[open_] == r] for r in range(PERIOD)]
    for a in range(PERIOD):
        for b in range(a, PERIOD):
            mine, theirs = by_residue[a], by_residue[b]
            if not len(mine) or not len(theirs):
                continue
            d = distance[a, b]
            name = tie[mine] * ranks + rank[at[mine] + d]
            if a == b:
                _, inverse, n = np.unique(name, return_inverse=True, return_counts=True)
                dup[mine] |= n[inverse] > 1
            else:
                other = tie[theirs] * ranks + rank[at[theirs] + d]
                dup[mine] |= np.isin(name, other)
                dup[theirs] |= np.isin(other, name)
    assert reach + 2 * 8 >= length
    return np.split(dup, np.cumsum(count)[:-1])


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of set flags: first and last."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [(int(a), int(b) - 1) for a, b in edges.reshape(-1, 2)]


RUNS = "doc_id long, th long, first int, last int"


def _sorted_block(t: pa.Table, length: int) -> pa.Table:
    """Runs of repeated suffixes of a block's contexts that stand alone."""
    rows = t.to_pydict()
    seen: dict[tuple, int] = {}
    for i, k in enumerate(zip(rows["key"], rows["c1"], rows["c2"], strict=True)):
        seen.setdefault(k, i)  # rows alike in doc_id and text give the same context twice
    own = sorted(seen.values())
    contexts = [rows["context"][i] for i in own]
    flags = repeated(contexts, np.array([rows["key"][i] for i in own], np.int64), length)
    out: dict = {"doc_id": [], "th": [], "first": [], "last": []}
    for i, f in zip(own, flags, strict=True):
        if rows["n"][i] == 1:
            for a, b in runs(f):
                for c, v in zip(out, (rows["doc_id"][i], rows["th"][i], rows["first"][i] + a, rows["first"][i] + b), strict=True):
                    out[c].append(v)
    return pa.table({c: pa.array(v, pa.int64() if c in ("doc_id", "th") else pa.int32()) for c, v in out.items()})


def _named(contexts: DataFrame, length: int) -> DataFrame:
    """For contexts of hot keys: each suffix that repeats, found by counting hashes of strings."""

    def batch(rows: dict) -> dict:
        out: dict = {c: [] for c in ("h1", "h2", "doc_id", "th", "at", "alone")}
        for doc_id, th, first, n, context in zip(*(rows[c] for c in ("doc_id", "th", "first", "n", "context")), strict=True):
            for i in range(len(context) - length + 1):
                h = xxhash.xxh3_128_digest(context[i : i + length])
                for c, v in zip(out, (int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), doc_id, th, first + i, n == 1), strict=True):
                    out[c].append(v)
        return out

    each = contexts.select("doc_id", "th", "first", "n", "context")
    names = map_batches(each, batch, "h1 long, h2 long, doc_id long, th long, at int, alone boolean")
    place = F.struct("doc_id", "th", "at")
    often = names.groupBy("h1", "h2").agg(F.min(place).alias("a"), F.max(place).alias("b")).where(F.col("a") != F.col("b")).select("h1", "h2")
    return names.where("alone").join(often, ["h1", "h2"]).select("doc_id", "th", F.col("at").alias("first"), F.col("at").alias("last"))


def covered(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """The maximal byte runs (start, end) under the strings of runs of suffixes."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


def _only(texts: DataFrame, hashes: DataFrame, scratch_count: int) -> DataFrame:
    """The rows of texts whose th may be among hashes."""
    bits = texts.sparkSession.sparkContext.broadcast(bitmap(hashes, "th", scratch_count))

    @F.pandas_udf("boolean")
    def may(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for th in batches:
            yield pd.Series(passes(th.to_numpy(), bits.value))

    return texts.where(may("th"))


def repeats(texts: DataFrame, length: int = LENGTH, key_bytes: int = KEY_BYTES, hot: int = HOT, block_bytes: int = BLOCK_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, th, spans): runs of suffixes whose first `length` bytes start elsewhere too.

    texts: doc_id, th (a hash of the text) and text as bytes.
    """
    spark = texts.sparkSession
    scratch = scratch or Scratch(spark, "suffixes")
    keys = scratch.write(_keys(texts, length, key_bytes).where("n > 1").select("key"))
    bits = spark.sparkContext.broadcast(bitmap(keys, "key", keys.count()))
    anchors = scratch.write(_anchors(texts, length, key_bytes, bits).join(keys, "key", "left_semi"))
    same = ["key", "c1", "c2"]
    contexts = anchors.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "place", "first", "last")).alias("one"))
    contexts = scratch.write(contexts)
    several = contexts.groupBy("key").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1").select("key", "kinds")
    wanted = scratch.write(contexts.join(several, "key").select(*same, "n", "kinds", "one.*"))
    # All suffixes of contexts that occur more than once.
    copied = anchors.join(contexts.where("n > 1").select(*same), same, "left_semi").select("doc_id", "th", "first", "last")
    of_doc = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*same, "n", "kinds", "first", "last")).alias("cuts"))
    docs = wanted.select("th").distinct()
    near = _only(texts, docs, docs.count()).alias("t").join(of_doc.alias("w").hint("shuffle_hash"), F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.th") == F.col("w.th")))
    cut = near.select("t.doc_id", "t.th", "t.text", F.explode("w.cuts").alias("c")).select("doc_id", "th", "c.*", F.expr(f"substring(text, c.first + 1, c.last - c.first + {length})").alias("context"))
    cut = scratch.write(cut)
    total = cut.agg(F.coalesce(F.sum(F.octet_length("context")), F.lit(0)).alias("bytes")).first()["bytes"]
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("long").alias("block")
    settled = cut.where(F.col("kinds") <= hot).select(block, *same, "doc_id", "th", "n", "first", "context").groupBy("block").applyInArrow(lambda t: _sorted_block(t, length), RUNS)
    named = _named(cut.where(F.col("kinds") > hot), length)
    found = scratch.write(copied.unionByName(settled).unionByName(named))
    return found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, removed array<struct<start:long,stop:long>>"
COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed")


def dedup(docs: DataFrame, length: int = LENGTH, **settings) -> DataFrame:
    """A row per document: what is removed, and (null if nothing is) what is kept."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), text_bytes().alias("text"))
    spans = scratch.write(repeats(texts, length, scratch=scratch, **settings))
    whole = texts.select("doc_id", "th", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("kept_sha256"))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))
    untouched = whole.alias("t").join(spans.alias("s"), same("t", "s"), "left_anti").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256", F.lit(None).cast("binary").alias("kept"), F.array().cast("array<struct<start:long,stop:long>>").alias("removed"))

    def batch(rows: dict) -> dict:
        out: dict = {c: [] for c in COLUMNS}
        for doc_id, raw, own in zip(rows["doc_id"], rows["text"], rows["spans"], strict=True):
            gone = covered([(s["first"], s["last"]) for s in own], length)
            ends = [0, *(e for _, e in gone)]
            kept = b"".join(raw[a:b] for a, b in zip(ends, [*(s for s, _ in gone), len(raw)], strict=True))
            for c, v in zip(COLUMNS, (doc_id, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "stop": b} for a, b in gone]), strict=True):
                out[c].append(v)
        return out

    near = _only(texts, spans, spans.count()).alias("t").join(spans.alias("s").hint("shuffle_hash"), same("t", "s"))
    return map_batches(near.select("t.doc_id", "t.text", "s.spans"), batch, RESULT).unionByName(untouched)
