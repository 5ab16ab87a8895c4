"""N-gram Jaccard self-join by MinHash banding, verified on full n-gram sets.

1. Texts become sets of hashed word n-grams. Texts with equal sets (by a 128-bit sum of
   hashes) form a class; further work is per class, so copies are never paired.
2. A class has `bands` keys, each from `rows` MinHash values. `plan_bands` chooses both so
   that a pair at the similarity sought shares a key with the target recall. The shuffle
   is on these keys. Within a key each class is tied to the key's smallest class only.
3. Components of these ties tell which classes can meet at all. A component is verified in
   units: as a whole, if it has few classes or if its keys would compare more pairs, or
   else key by key, where a pair counts at the first key that it shares. So a long chain of
   loosely tied classes costs what its keys hold, and a group of near copies, who share
   most of their keys, is still compared once. Texts travel to their units; a unit of more
   than `block` classes is cut into parts, and each pair of parts is a task.
4. There n-gram sets are intersected by matrix products over the n-grams that at least two
   members have. All pairs at the similarity count as links of both sides, weighted by
   copies; only a spanning forest of them is given out.
5. Components of the forest are the classes of documents that are linked directly or not.

So rows follow the number of documents, not of pairs, and no pair that shares a key
escapes verification. What banding misses is one pair in 10,000 or fewer of those at
exactly the similarity sought, and fewer above.

Null and empty texts and texts without words have no n-gram: they link to nothing and are
a class of their own. A text of one to four words has one n-gram of all of them. Repeated
rows are copies. Null doc_ids are carried; class_id is the smallest doc_id of a class
that is not null. An empty table gives an empty result. Columns besides doc_id and text
are not read (`clean` carries them along, whatever their names).
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free_names, map_batches, text_bytes
from .graph import components
from .shingles import mix, sets, shingle_hashes

WORDS, SIMILARITY, RECALL, ROWS = 5, 0.8, 0.9999, 6
#: Classes of a group that one task holds; n-grams of at most SPARSE members are counted pair by pair.
BLOCK, SPARSE, COLUMNS = 256, 8, 4096


def plan_bands(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """The number of bands of `rows` values by which a pair of this similarity is met with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def band_keys(hashes: np.ndarray, after: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys by text and band; texts without n-grams get zeros. Blocks of texts keep the work in cache."""
    n = len(after) - 1
    keys = np.zeros((n, bands), np.int64)
    some = np.flatnonzero(np.diff(after))
    cut = [0, *(np.searchsorted(after[some], np.arange(1 << 15, after[-1], 1 << 15))), len(some)]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if a == b:
            continue
        own = some[a:b]
        h = hashes[after[own[0]] : after[own[-1] + 1]]
        starts = after[own] - after[own[0]]
        for band in range(bands):
            key = np.full(len(own), band, np.uint64)
            for row in range(rows):
                k = band * rows + row
                factor = np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % 2**64 | 1)
                spread = np.uint64((k + 1) * 0xD1B54A32D192ED03 % 2**64)
                key = mix(key ^ np.minimum.reduceat((h ^ spread) * factor, starts))
            keys[own, band] = key.view(np.int64)
    return keys


def signed(texts: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, th (hash of text), n1 and n2 (of the set; null without n-grams) and keys of each row."""

    def batch(table: dict) -> dict:
        out: dict = {"doc_id": table["doc_id"], "th": table["th"], "n1": [], "n2": [], "keys": []}
        at, raw = 0, table["text"]
        while at < len(raw):
            end, n = at, 0
            while end < len(raw) and (end == at or n + len(raw[end]) < 1 << 21):
                n += len(raw[end])
                end += 1
            h, after = sets(*shingle_hashes(raw[at:end], words))
            keys, sizes = band_keys(h, after, bands, rows), np.diff(after)
            for c, salt in (("n1", 2), ("n2", 3)):
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h, salt))))
                name = mix(sums[after[1:]] - sums[after[:-1]] + sizes.astype(np.uint64)).view(np.int64)
                out[c] += [x if size else None for x, size in zip(name.tolist(), sizes.tolist(), strict=True)]
            out["keys"] += [own if size else None for own, size in zip(keys, sizes.tolist(), strict=True)]
            at = end
        return out

    return map_batches(texts, batch, "doc_id long, th long, n1 long, n2 long, keys array<long>")


def shared(sides: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sizes of all intersections of the members' sets, as a matrix. sides: (hashes, member numbers), joined."""
    h, member = (np.concatenate([s[k] for s in sides]) for k in (0, 1))
    m = int(member.max()) + 1 if len(member) else 0
    order = np.argsort(h, kind="stable")
    h, member = h[order], member[order]
    starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    many = np.diff(np.append(starts, len(h)))
    out = np.zeros((m, m), np.float32)
    for k in range(2, SPARSE + 1):  # n-grams of few members: each of their pairs
        at = starts[many == k]
        if len(at):
            who = member[at[:, None] + np.arange(k)]
            for i in range(k):
                for j in range(k):
                    if i != j:
                        np.add.at(out, (who[:, i], who[:, j]), 1)
    at, n = starts[many > SPARSE], many[many > SPARSE]
    for c in range(0, len(at), COLUMNS):
        x = np.zeros((m, min(COLUMNS, len(at) - c)), np.float32)
        own = n[c : c + COLUMNS]
        rows = np.concatenate([member[a : a + k] for a, k in zip(at[c : c + COLUMNS], own, strict=True)])
        x[rows, np.repeat(np.arange(len(own)), own)] = 1
        out += x @ x.T
    return out


def spanning(pairs: np.ndarray, m: int) -> list[int]:
    """The smallest member that each of m members is linked with, directly or not."""
    root = list(range(m))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(m)]


VERIFIED = "node long, root long, links long"


def _verify(t: pa.Table, words: int, similarity: Fraction, band: int, whole: bool) -> pa.Table:
    """Links and forest of a task's members: of a pair of parts, only those between the two; of a key, only pairs without an earlier one."""
    t = t.take(pa.array(np.unique(t["node"].to_numpy(), return_index=True)[1]))
    node, copies = t["node"].to_numpy(), t["copies"].to_numpy()
    side = t["part"].to_numpy()
    open_ = np.ones((len(node), len(node)), bool) if whole else side[:, None] != side[None]
    if band > 0:
        keys = np.stack(t["keys"].to_numpy(zero_copy_only=False))
        for k in range(band):
            open_ &= keys[:, k][:, None] != keys[:, k][None]
    np.fill_diagonal(open_, False)
    some = np.flatnonzero(open_.any(axis=1))
    t, node, copies, open_ = t.take(pa.array(some)), node[some], copies[some], open_[np.ix_(some, some)]
    h, after = sets(*shingle_hashes(t["text"].to_pylist(), words))
    size = np.diff(after)
    both = shared([(h, np.repeat(np.arange(len(node)), size))])
    if len(both) < len(node):
        both = np.pad(both, (0, len(node) - len(both)))
    total = size[:, None] + size[None]
    # c / (total - c) >= p / q, in whole numbers
    linked = open_ & (both.astype(np.int64) * (similarity.denominator + similarity.numerator) >= similarity.numerator * total)
    root = spanning(np.argwhere(np.triu(linked)), len(node))
    return pa.table({"node": node, "root": node[root], "links": linked @ copies})


def _units(classes: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """(node, unit, band, members): what is verified together; band -1: a whole component."""
    keyed = classes.select("node", F.posexplode("keys").alias("band", "key")).withColumn("key", F.xxhash64("band", "key"))
    filled = scratch.write(keyed.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count("*").alias("members")).where("members > 1"))
    shared_keys = scratch.write(keyed.join(filled, ["band", "key"]))
    groups = components(shared_keys.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")), scratch)
    rooted = filled.join(groups, F.col("hub") == F.col("node"))
    by_keys = rooted.groupBy("root").agg(F.sum(F.col("members") * (F.col("members") - 1.0)).alias("by_keys"))
    costs = groups.groupBy("root").agg(F.count("*").alias("members")).join(by_keys, "root")
    split = (F.col("members") > block) & (F.col("by_keys") < F.col("members") * (F.col("members") - 1.0))
    costs = scratch.write(costs.select("root", "members", split.alias("split")))
    whole = groups.join(costs.where("NOT split"), "root").select("node", F.col("root").alias("unit"), F.lit(-1).alias("band"), "members")
    own = groups.join(costs.where("split").select("root"), "root").select("node")
    return whole.unionByName(shared_keys.join(own, "node").select("node", F.col("key").alias("unit"), "band", "members"))


def join(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """A row per document: class_id, n_links (documents at least this similar), n_equal (those with the same set), keeper.

    keeper: whether the row is the one of its class that stays, the first by doc_id and
    hash of text; repeated rows are keepers alike. `th` is the hash of the text.
    """
    scratch = Scratch(docs.sparkSession, "ngrams")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), text_bytes().alias("text"))
    signs = scratch.write(signed(texts, words, plan_bands(similarity, recall, rows), rows))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    classes = signs.where(F.col("n1").isNotNull()).groupBy("n1", "n2").agg(first, F.count("*").alias("copies"), F.min("keys").alias("keys"))
    classes = scratch.write(classes.withColumn("node", F.monotonically_increasing_id()))  # fixed by being written
    units = _units(classes, scratch, block)
    placed = units.withColumn("parts", F.ceil(F.col("members") / block).cast("int")).withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))
    keys = F.when(F.col("band") > 0, F.col("keys")).alias("keys")
    placed = placed.join(classes.select("node", "first", "copies", "keys"), "node").select("node", "unit", "band", "parts", "part", "copies", keys, F.col("first.doc_id").alias("id"), F.col("first.th").alias("hash"))
    placed = scratch.write(placed)
    own = texts.join(placed.hint("shuffle_hash"), texts["doc_id"].eqNullSafe(placed["id"]) & (texts["th"] == placed["hash"]))
    # Part i meets every part: (i, j) for i <= j; within (i, i) all pairs count, else those across.
    met = own.select("node", "unit", "band", "part", "copies", "keys", "text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"), "parts")
    met = met.select("node", "unit", "band", "part", "copies", "keys", "text", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("parts") > 1).alias("cut"))
    level = Fraction(str(similarity))

    def verify(key: tuple, t: pa.Table) -> pa.Table:
        return _verify(t, words, level, key[1].as_py(), key[2].as_py() == key[3].as_py())

    checked = scratch.write(met.groupBy("unit", "band", "i", "j", "cut").applyInArrow(verify, VERIFIED))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    known = classes.select("n1", "n2", "node", "first", "copies").join(links, "node", "left").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = known.groupBy("root").agg(F.min("first").alias("head"))
    by_set = known.join(heads, "root").select("n1", "n2", F.col("head.doc_id").alias("class_id"), F.col("head.th").alias("class_th"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_equal"))
    by_set = scratch.write(by_set)
    for old in (classes, placed, checked):
        scratch.drop(old)
    out = signs.select("doc_id", "th", "n1", "n2").join(by_set, ["n1", "n2"], "left")
    alone = F.col("class_th").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_equal", F.lit(1)).cast("long").alias("n_equal"),
        (alone | F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("th") == F.col("class_th"))).alias("keeper"),
        "th",
    )


def clean(docs: DataFrame, **settings) -> DataFrame:
    """One document of each class, with all its columns; texts without n-grams all stay."""
    th, own_id, own_th, number = free_names(docs, "th", "own_id", "own_th", "number")
    wordless = ~F.coalesce("text", F.lit("")).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    stays = join(docs, **settings).where("keeper").select(F.col("doc_id").alias(own_id), F.col("th").alias(own_th)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.col(th) == F.col(own_th))
    kept = docs.where(~wordless).withColumn(th, F.xxhash64("text")).join(stays.hint("shuffle_hash"), same)
    one = F.row_number().over(Window.partitionBy(own_id, own_th).orderBy(own_th))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return kept.withColumn(number, one).where(F.col(number) == 1).select(*columns).unionByName(docs.where(wordless))
