"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised bytewise: A-Z become lower case, every other ASCII byte that is no
letter or digit becomes a space, all other bytes stay; so a byte's place is the same
before and after, and words map back to spans of the original. Windows of 13 consecutive
item words (all words of an item that has fewer) are the automaton's patterns, with a
space at either end. Each text runs through the automaton once. There is no shuffle.

The items are collected and broadcast only after their size is measured: patterns of up to
`max_pattern_bytes` make one automaton, and that is all the driver and a task ever hold. A
larger test set is dealt to passes of that size. Each writes the hits of the documents that
have any to the shared folder, and a document's hits are united.

Null texts have no words: as documents they give zeros, as items no window. An item of
fewer than 13 words is one window. Equal windows of different items count for each of
them. An item_id that repeats counts once; items without item_id count as one item, shown
as "null" in the digest. Documents that repeat give a row each. Empty tables give empty
results, or zeros. Other columns of either table are not read (`clean` carries the
documents' along, whatever their names).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, free_names, map_batches, text_bytes

WINDOW = 13
#: A document counts as contaminated from this share of hit words on: 1/20.
SHARE = 20

#: Fixed rule: 0-9 a-z and all bytes from 0x80 stay, A-Z are lowered, the rest separates.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")


def normal_words(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(NORMAL).split()


def windows(words: list[bytes], n: int = WINDOW) -> Iterator[bytes]:
    """The windows of an item, each between two spaces."""
    for i in range(max(1, len(words) - n + 1) if words else 0):
        yield b" " + b" ".join(words[i : i + n]) + b" "


def automaton(items: list[tuple[str | None, list[bytes]]]):
    """Patterns carry their number of words and the items that have them."""
    import ahocorasick

    has: dict[bytes, set[str | None]] = {}
    for item_id, words in items:
        for w in windows(words):
            has.setdefault(w, set()).add(item_id)
    a = ahocorasick.Automaton()
    for w, ids in has.items():
        a.add_word(w.decode("latin-1"), (w.count(b" ") - 1, len(w), tuple(ids)))
    if has:
        a.make_automaton()
    return a if has else None


def scan(a, words: list[bytes]) -> tuple[np.ndarray, set[str | None]]:
    """Which words lie in an occurrence of a window, and whose windows occur."""
    hit, ids = np.zeros(len(words) + 1, np.int32), set()
    if a is None or not words:
        return hit[:-1].astype(bool), ids
    text = b" " + b" ".join(words) + b" "
    starts = None
    for end, (n, size, owners) in a.iter(text.decode("latin-1")):
        if starts is None:
            starts = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        first = int(np.searchsorted(starts, end - size + 1))
        hit[first] += 1
        hit[first + n] -= 1
        ids.update(owners)
    return np.cumsum(hit)[:-1] > 0, ids


def spans(raw: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Hit runs as code-point intervals of the original text."""
    if not hit.any():
        return []
    places = [m.span() for m in WORD.finditer(raw.translate(NORMAL))]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    lead = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [(int(lead[places[a][0]]), int(lead[places[b - 1][1]])) for a, b in edges.reshape(-1, 2)]


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>, hit_spans array<struct<start:long,stop:long>>"
NAMES = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "hit_spans")


def contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and SHARE * n_hit >= n_words


def shown(ids: set[str | None]) -> list[str]:
    """Names of items in the order of the digest."""
    return sorted("null" if i is None else i for i in ids)


def _passes(benchmark: DataFrame, max_pattern_bytes: int) -> list[DataFrame]:
    """The items in as many parts as their patterns need."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    weight = items.agg(F.coalesce(F.sum(F.octet_length("text") * F.lit(WINDOW)), F.lit(0)).alias("bytes")).first()["bytes"]
    parts = max(1, -(-weight // max_pattern_bytes))
    return [items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) for k in range(parts)]


def _sent(items: DataFrame):
    return items.sparkSession.sparkContext.broadcast([(r["item_id"], normal_words(r["text"])) for r in items.toLocalIterator()])


def _result(rows: dict, hits: Iterator[tuple[np.ndarray, set]]) -> dict:
    out: dict = {c: [] for c in NAMES}
    for doc_id, raw, (hit, ids) in zip(rows["doc_id"], rows["text"], hits, strict=True):
        k, names = int(hit.sum()), shown(ids)
        for c, v in zip(NAMES, (doc_id, len(hit), k, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), contaminated(k, len(hit)), names, [{"start": a, "stop": b} for a, b in spans(raw, hit)]), strict=True):
            out[c].append(v)
    return out


FOUND = "doc_id long, th long, first array<int>, stop array<int>, ids array<string>"


def _found(docs: DataFrame, passes: list[DataFrame]) -> DataFrame:
    """Hit runs of words and item ids by (doc_id, th), for documents that have any, united over the passes."""
    scratch, found = Scratch(docs.sparkSession, "benchmark"), None
    for items in passes:
        sent = _sent(items)

        def batch(rows: dict, a, sent=sent) -> dict:
            out: dict = {c.split(" ")[0]: [] for c in FOUND.split(", ")}
            for doc_id, th, raw in zip(rows["doc_id"], rows["th"], rows["text"], strict=True):
                hit, ids = scan(a, normal_words(raw))
                if ids:
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                    for c, v in zip(out, (doc_id, th, edges[::2].tolist(), edges[1::2].tolist(), list(ids)), strict=True):
                        out[c].append(v)
            return out

        one = scratch.write(map_batches(docs, batch, FOUND, lambda sent=sent: {"a": automaton(sent.value)}).dropDuplicates(["doc_id", "th"]))
        sent.destroy()
        found = one if found is None else found.unionByName(one)
    return found.groupBy("doc_id", "th").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("first", "stop", "ids")))


def mark(docs: DataFrame, benchmark: DataFrame, max_pattern_bytes: int = 64 << 20) -> DataFrame:
    """A row per document: its words, hit words, occurring items, verdict, and hit spans in code points."""
    passes = _passes(benchmark, max_pattern_bytes)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), text_bytes().alias("text"))
    if len(passes) == 1:
        sent = _sent(passes[0])

        def batch(rows: dict, a) -> dict:
            return _result(rows, (scan(a, normal_words(raw)) for raw in rows["text"]))

        return map_batches(own.select("doc_id", "text"), batch, SCHEMA, lambda: {"a": automaton(sent.value)})

    def hits(rows: dict) -> Iterator[tuple[np.ndarray, set]]:
        for raw, first, stop, ids in zip(rows["text"], rows["first"], rows["stop"], rows["ids"], strict=True):
            hit = np.zeros(len(normal_words(raw)), bool)
            for a, b in zip(first or (), stop or (), strict=True):
                hit[a:b] = True
            yield hit, set(ids or ())

    found = _found(own, passes).alias("f").hint("shuffle_hash")
    both = own.alias("d").join(found, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.th") == F.col("f.th")), "left")
    return map_batches(both.select("d.doc_id", "d.text", "f.first", "f.stop", "f.ids"), lambda rows: _result(rows, hits(rows)), SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, max_pattern_bytes: int = 64 << 20) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    passes = _passes(benchmark, max_pattern_bytes)
    if len(passes) > 1:
        th, own_id, own_th = free_names(docs, "th", "own_id", "own_th")
        keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
        found = _found(keyed.select("doc_id", "th", text_bytes().alias("text")), passes)
        hit = F.size(F.array_distinct(F.flatten(F.transform(F.arrays_zip("first", "stop"), lambda r: F.sequence(r["first"], r["stop"] - 1)))))
        words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
        n = keyed.dropDuplicates(["doc_id", "th"]).alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.th") == F.col("f.th")))
        dirty = n.where((hit > 0) & (SHARE * hit >= words)).select(F.col("d.doc_id").alias(own_id), F.col("d.th").alias(own_th))
        same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.col(th) == F.col(own_th))
        return docs.withColumn(th, F.xxhash64("text")).join(dirty, same, "left_anti").drop(th)
    bounded_batches(docs.sparkSession)
    sent = _sent(passes[0])

    @F.pandas_udf("boolean")
    def dirty(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = automaton(sent.value)
        for texts in batches:
            found = (scan(a, normal_words(raw))[0] for raw in texts)  # a text's words at a time
            yield pd.Series([contaminated(int(hit.sum()), len(hit)) for hit in found], dtype=bool)

    return docs.where(~dirty(text_bytes()))


#: What `mark` returns, without item_ids and hit_spans.
ORACLE = r"""
WITH bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, len(w[i:i + 12]) AS n, array_to_string(w[i:i + 12], ' ') AS s FROM bi),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
dn AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, sizes WHERE len(w) >= n),
hit AS (SELECT dn.doc_id, dn.i, dn.n, win.item_id FROM dn JOIN win ON win.n = dn.n AND win.s = array_to_string(dn.w[dn.i:dn.i + dn.n - 1], ' ')),
places AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM hit) GROUP BY doc_id),
owners AS (SELECT doc_id, count(*) AS n_items, string_agg(coalesce(item_id, 'null'), ',' ORDER BY coalesce(item_id, 'null')) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(dw.w) AS contaminated
FROM dw LEFT JOIN places USING (doc_id) LEFT JOIN owners USING (doc_id)
"""
