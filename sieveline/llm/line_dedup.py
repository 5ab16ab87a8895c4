"""Line dedup: lines found in many documents are dropped everywhere.

1. Each task hashes its lines (128 bits) and counts, per batch, in how many documents a
   line occurs; the counts are summed by hash.
2. The distinct hashes are dealt to shards of bounded size. A shard is a minimal perfect
   hash over its hashes, with a fingerprint and a count array in its order.
3. Lines of more than T / FRONT documents (T: the sum of all counts) go into one more
   index, the front. There are at most FRONT of these, so its size has a bound; it is built
   once and broadcast. All documents probe it where they are read.
4. The other lines travel as hashes with the place they come from, one row per batch and
   hash, to the shard, probe its arrays, and only places to drop travel back. No key has
   more than T / FRONT places there, so no group is unbounded.
5. Documents meet their own drop list by (doc_id, hash of text).

Null and empty texts are one empty line. A key is a line without white space at both ends
and with A-Z lowered; a key of fewer than `min_points` code points is never dropped. Each
row counts as a document, also if it repeats another one; rows alike in doc_id and text
get the same result. Null doc_ids are kept. An empty table gives an empty result. Columns
besides doc_id and text are carried along untouched, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_names, map_batches

MIN_DOCS, MIN_POINTS = 10, 1
#: Hashes in a shard; places in a shard; entries of the front.
SHARD_KEYS, SHARD_PLACES, FRONT = 200_000, 400_000, 100_000
#: Bits of a level of the perfect hash per key, and levels before the rest is listed.
GAMMA, LEVELS = 2.0, 24

MIX = 0x9E3779B97F4A7C15


def line_key(line: bytes) -> bytes:
    """Without ASCII white space at both ends, A-Z lowered."""
    return line.strip().lower()


def line_keys(text: bytes | None) -> list[bytes]:
    return [line_key(x) for x in (text or b"").split(b"\n")]


def long_enough(key: bytes, min_points: int) -> bool:
    return len(key) >= min_points and (len(key) >= 4 * min_points or len(key.decode("utf-8", "replace")) >= min_points)


def hash_of(key: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", xxhash.xxh3_128_digest(key))


class PerfectHash:
    """Minimal perfect hash of 64-bit keys, built level by level: bits that one key alone sets."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks = [np.concatenate(([0], np.cumsum(np.unpackbits(x).reshape(-1, 64).sum(axis=1)))) for x in levels]
        self.starts = np.concatenate(([0], np.cumsum([r[-1] for r in self.ranks]))).astype(np.int64)

    @staticmethod
    def _at(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        x = (keys ^ np.uint64((level + 1) * MIX % 2**64)) * np.uint64(MIX)
        x = (x ^ x >> np.uint64(31)) * np.uint64(MIX)
        return ((x ^ x >> np.uint64(29)) % np.uint64(bits)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        for level in range(LEVELS):
            if not len(keys):
                break
            bits = -(-max(64, int(GAMMA * len(keys))) // 64) * 64
            at = cls._at(keys, level, bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone))
            keys = keys[~alone[at]]
        return cls(levels, np.sort(keys))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys; any place or -1 for a key that was not built in."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bytes_ in enumerate(self.levels):
            at = self._at(keys[open_], level, len(bytes_) * 8)
            there = (bytes_[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            own, at = open_[there], at[there]
            words = np.unpackbits(bytes_.reshape(-1, 8)[at >> 6], axis=1) if len(at) else np.zeros((0, 64), np.uint8)
            before = np.where(np.arange(64)[None] < (at & 63)[:, None], words, 0).sum(axis=1)
            out[own] = self.starts[level] + self.ranks[level][at >> 6] + before
            open_ = open_[~there]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            found = self.rest[at] == keys[open_]
            out[open_[found]] = self.starts[-1] + at[found]
        return out

    def dump(self) -> bytes:
        parts = [*self.levels, self.rest.view(np.uint8)]
        return struct.pack(f"<{len(parts) + 1}q", len(parts), *map(len, parts)) + b"".join(p.tobytes() for p in parts)

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        n = struct.unpack_from("<q", data)[0]
        sizes, at, parts = struct.unpack_from(f"<{n}q", data, 8), 8 * (n + 1), []
        for s in sizes:
            parts.append(np.frombuffer(data, np.uint8, s, at))
            at += s
        return cls(parts[:-1], parts[-1].view(np.uint64) if sizes[-1] else np.zeros(0, np.uint64))


class Index:
    """A perfect hash with fingerprints (the other 64 bits) and counts in its order.

    Distinct hashes that agree in their first 64 bits are next to none; all but one of
    them are listed behind.
    """

    def __init__(self, places: PerfectHash, fingerprints: np.ndarray, counts: np.ndarray, extras: np.ndarray):
        self.places, self.fingerprints, self.counts, self.extras = places, fingerprints, counts, extras

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> Index:
        n, first = np.minimum(n, 2**32 - 1), np.zeros(len(h1), bool)
        first[np.unique(h1, return_index=True)[1]] = True
        extras = np.stack([h1[~first], h2[~first], n[~first]], axis=1).astype(np.int64)
        h1, h2, n = h1[first], h2[first], n[first]
        places = PerfectHash.build(h1.view(np.uint64))
        at = places.index(h1.view(np.uint64))
        f, c = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.uint32)
        f[at], c[at] = h2, n
        return cls(places, f, c, extras)

    def count(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Counts; 0 for hashes that were not built in."""
        if not len(self.counts):
            return np.zeros(len(h1), np.uint32)
        at = self.places.index(h1.view(np.uint64))
        out = np.where((at >= 0) & (self.fingerprints[at] == h2), self.counts[at], 0)
        for a, b, n in self.extras:
            out[(h1 == a) & (h2 == b)] = n
        return out

    def dump(self) -> dict[str, bytes]:
        return {"places": self.places.dump(), "fingerprints": self.fingerprints.tobytes(), "counts": self.counts.tobytes(), "extras": self.extras.tobytes()}

    @classmethod
    def load(cls, x: dict[str, bytes]) -> Index:
        return cls(PerfectHash.load(x["places"]), np.frombuffer(x["fingerprints"], np.int64), np.frombuffer(x["counts"], np.uint32), np.frombuffer(x["extras"], np.int64).reshape(-1, 3))


def _counted(docs: DataFrame, min_points: int) -> DataFrame:
    """(h1, h2, n) of all lines, summed within batches."""

    def batch(rows: dict) -> dict:
        n: dict[bytes, int] = {}
        for text in rows["text"]:
            for key in {*line_keys(text)}:
                n[key] = n.get(key, 0) + 1
        pairs = [hash_of(k) for k in n if long_enough(k, min_points)]
        return {"h1": [a for a, _ in pairs], "h2": [b for _, b in pairs], "n": [v for k, v in n.items() if long_enough(k, min_points)]}

    return map_batches(docs.select("text"), batch, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def _built(counted: DataFrame) -> DataFrame:
    """A row per shard: its perfect hash and arrays."""

    def build(t: pa.Table) -> pa.Table:
        x = Index.build(*(t[c].to_numpy() for c in ("h1", "h2", "n")))
        return pa.table({"shard": t["shard"].slice(0, 1)} | {k: [v] for k, v in x.dump().items()})

    return counted.groupBy("shard").applyInArrow(build, "shard long, places binary, fingerprints binary, counts binary, extras binary")


PLACE = "struct<doc_id:long,th:long,line:int>"


def _probes(docs: DataFrame, front, min_docs: int, min_points: int) -> DataFrame:
    """Rows (h1, h2, places, drop) per batch and line hash; drop: the front has said so already."""

    def setup() -> dict:
        return {"index": Index.load(front.value)}

    def batch(rows: dict, index: Index) -> dict:
        places: dict[bytes, list] = {}
        for doc_id, th, text in zip(rows["doc_id"], rows["th"], rows["text"], strict=True):
            for i, key in enumerate(line_keys(text)):
                places.setdefault(key, []).append({"doc_id": doc_id, "th": th, "line": i})
        keys = [k for k in places if long_enough(k, min_points)]
        h = np.array([hash_of(k) for k in keys], np.int64).reshape(-1, 2)
        return {"h1": h[:, 0], "h2": h[:, 1], "places": [places[k] for k in keys], "drop": index.count(h[:, 0].copy(), h[:, 1]) >= min_docs}

    return map_batches(docs, batch, f"h1 long, h2 long, places array<{PLACE}>, drop boolean", setup)


def _answers(arrays: pa.Table, probes: pa.Table, min_docs: int) -> pa.Table:
    import pyarrow.compute as pc

    if not arrays.num_rows or not probes.num_rows:
        return probes.select(["places"]).slice(0, 0)
    index = Index.load(arrays.slice(0, 1).to_pylist()[0])
    drop = index.count(probes["h1"].to_numpy(), probes["h2"].to_numpy()) >= min_docs
    return pc.filter(probes.select(["places"]), pa.array(drop))


def rebuilt(text: bytes | None, drop: list[int] | None) -> bytes:
    if not drop:
        return text or b""
    gone = set(drop)
    return b"\n".join(x for i, x in enumerate((text or b"").split(b"\n")) if i not in gone)


def drop_lists(docs: DataFrame, min_docs: int = MIN_DOCS, min_points: int = MIN_POINTS, shard_keys: int = SHARD_KEYS, front_size: int = FRONT) -> DataFrame:
    """(doc_id, th, lines): the line numbers to drop, for documents that lose any. th: a hash of the text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    counted = scratch.write(_counted(own, min_points))
    size = counted.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("places")).first()
    shards = max(1, -(-size["keys"] // shard_keys), -(-size["places"] // SHARD_PLACES))
    shard = F.pmod("h1", F.lit(shards)).cast("long").alias("shard")
    # At most front_size hashes have more than places / front_size documents.
    cut = max(min_docs, size["places"] // front_size + 1)
    often = counted.where(F.col("n") >= cut).orderBy(F.desc("n"), "h1", "h2").limit(front_size).toArrow()
    front = spark.sparkContext.broadcast(Index.build(*(often[c].to_numpy() for c in ("h1", "h2", "n"))).dump())
    arrays = scratch.write(_built(counted.select(shard, "h1", "h2", "n")))
    scratch.drop(counted)
    probes = scratch.write(_probes(own, front, min_docs, min_points))
    front.destroy()
    answered = probes.where(~F.col("drop")).select(shard, "h1", "h2", "places").groupBy("shard").cogroup(arrays.groupBy("shard")).applyInArrow(lambda probes, arrays: _answers(arrays, probes, min_docs), f"places array<{PLACE}>")
    drops = probes.where("drop").select("places").unionByName(answered).select(F.explode("places").alias("p"))
    out = scratch.write(drops.groupBy(F.col("p.doc_id").alias("doc_id"), F.col("p.th").alias("th")).agg(F.collect_set("p.line").alias("lines")))
    scratch.drop(arrays)
    scratch.drop(probes)
    return out


def dedup(docs: DataFrame, name: str, **settings) -> DataFrame:
    """docs with one more column of this name: the line numbers to drop (null: none)."""
    th, own_id, own_th, lines = free_names(docs.withColumn(name, F.lit(0)), "th", "id", "own_th", "lines")
    drops = drop_lists(docs, **settings).toDF(own_id, own_th, lines)
    keyed = docs.withColumn(th, F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.col(th) == F.col(own_th))
    return keyed.join(drops.hint("shuffle_hash"), same, "left").withColumn(name, F.col(lines)).drop(th, own_id, own_th, lines)


RESULT = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept string"


def report(docs: DataFrame, **settings) -> DataFrame:
    """A row per document: lines before, lines dropped, and what is left."""
    import hashlib

    def batch(rows: dict) -> dict:
        out: dict = {"doc_id": rows["doc_id"], "n_lines": [], "n_dropped": [], "kept_sha256": [], "kept": []}
        for text, lines in zip(rows["text"], rows["lines"], strict=True):
            kept = rebuilt(text, lines)
            for c, v in (("n_lines", (text or b"").count(b"\n") + 1), ("n_dropped", len(lines or ())), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept.decode())):
                out[c].append(v)
        return out

    found = dedup(docs.select("doc_id", "text"), "lines", **settings)
    return map_batches(found.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), "lines"), batch, RESULT)


def clean(docs: DataFrame, **settings) -> DataFrame:
    """docs, with their own columns, without the lines that are dropped; n_chars, if there, follows the text."""

    @F.pandas_udf("string")
    def keep(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lines in batches:
            yield pd.Series([rebuilt(t, list(d) if d is not None else None).decode() for t, d in zip(texts, lines, strict=True)], dtype=object)

    (lines,) = free_names(docs, "lines_to_drop")
    found = dedup(docs, lines, **settings)
    changed = F.col(lines).isNotNull()
    out = found.withColumn("text", F.when(changed, keep(F.coalesce("text", F.lit("")).cast("binary"), lines)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


#: What `report` returns, without `kept`, at the default settings.
ORACLE = """
WITH parts AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT doc_id, i, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM parts),
often AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT doc_id, i, line, k IN (SELECT k FROM often) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id
"""
