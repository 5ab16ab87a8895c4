"""Texts against a stated set of queries, in scans of the texts.

As in `dense`, the queries go to all tasks, in passes if their size is beyond `QUERY_BYTES`. A
task counts the terms of its own texts, multiplies them with the queries over an inverted list
of these, and gives out only its best k per query. No posting is shuffled or stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dense as D

#: Scores that a task holds at once, for each setting.
CELLS = 1 << 18


def half_up(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Rounded as SQL rounds."""
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


class Best:
    """The k best documents of each key, by a rounded score, then by id; with values that go along."""

    def __init__(self, keys: int, k: int):
        self.k, self.floor = k, np.full(keys, -np.inf)
        self.key, self.doc, self.size = (np.zeros(0, np.int64) for _ in range(3))
        self.score, self.value = np.zeros(0), np.zeros(0)

    def add(self, key: np.ndarray, score: np.ndarray, doc: np.ndarray, value: np.ndarray, size: np.ndarray) -> None:
        fit = score >= self.floor[key]
        if not fit.any():
            return
        key, score, doc, value, size = (np.concatenate((a, b[fit])) for a, b in ((self.key, key), (self.score, score), (self.doc, doc), (self.value, value), (self.size, size)))
        order = np.lexsort((doc, -score, key))
        place = np.arange(len(key)) - np.searchsorted(key[order], key[order])
        last = order[place == self.k - 1]
        self.floor[key[last]] = score[last]
        order = order[place < self.k]
        self.key, self.score, self.doc, self.value, self.size = key[order], score[order], doc[order], value[order], size[order]


@dataclass
class Asked:
    """Queries as an inverted list: those of term i are query[start[i]:start[i + 1]]."""

    ids: np.ndarray
    sizes: np.ndarray
    terms: pa.Array
    start: np.ndarray
    query: np.ndarray


def _inverted(rows: pa.Table) -> Asked:
    tokens = rows["tokens"].combine_chunks()
    sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    term = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(term, kind="stable")
    start = np.searchsorted(term[order], np.arange(len(coded.dictionary) + 1))
    return Asked(rows["query_id"].to_numpy(), sizes, coded.dictionary, start, np.repeat(np.arange(len(sizes)), sizes)[order])


def _counted(tokens: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) of the terms that occur, by row."""
    n = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    term = pc.fill_null(pc.index_in(tokens.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    own = term >= 0
    code, tf = np.unique(np.repeat(np.arange(len(n)), n)[own] * max(1, len(terms)) + term[own], return_counts=True)
    return code // max(1, len(terms)), code % max(1, len(terms)), tf


def _cells(row: np.ndarray, term: np.ndarray, asked: Asked) -> tuple[np.ndarray, np.ndarray]:
    """For each (row, term) how many queries have it; and the cells (row, query) that these fall in."""
    n = asked.start[term + 1] - asked.start[term]
    place = np.repeat(asked.start[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return n, np.repeat(row * len(asked.ids), n) + asked.query[place]


def _statistics(docs: DataFrame, sent: Broadcast) -> tuple[np.ndarray, int, float]:
    """The documents that have each of the queries' terms, the number of documents and their mean length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value.terms
        df, whole = np.zeros(len(terms), np.int64), np.zeros(3, np.int64)
        for batch in batches:
            df += np.bincount(_counted(batch["tokens"], terms)[1], minlength=len(terms))
            n = pc.list_value_length(batch["tokens"])
            whole += (batch.num_rows, batch.num_rows - n.null_count, pc.sum(n).as_py() or 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-3, len(terms))), pa.array(np.concatenate((whole, df)))], names=["term", "n"])

    rows = docs.select("tokens").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at = dict(zip(rows["term"].to_pylist(), rows["n"].to_pylist(), strict=True))
    df = np.array([at.get(i, 0) for i in range(len(sent.value.terms))], np.int64)
    return df, at.get(-3, 0), at.get(-1, 0) / max(1, at.get(-2, 0))


def _search(queries: DataFrame, docs: DataFrame, k: int, settings: int, prepared: Callable, weights: Callable, rounded: Callable) -> DataFrame:
    """(setting, query_id, q_n, doc_id, dl, value): the k best documents of each query by each setting, of every task.

    queries: query_id, tokens, distinct; docs: doc_id, tokens. `prepared` of the sent queries is what
    `weights(it, term, tf, dl)` gets: a list of weights, by setting. A value is their sum over terms.
    """
    spark = docs.sparkSession
    queries = queries.where(F.size("tokens") > 0)
    bytes_ = queries.select((F.lit(64) + F.octet_length(F.array_join("tokens", " ")) + 24 * F.size("tokens")).alias("n")).agg(F.sum("n")).first()[0]
    passes = max(1, -(-(bytes_ or 0) // D.QUERY_BYTES))

    def one(i: int) -> tuple[DataFrame, Broadcast]:
        own = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)
        sent = spark.sparkContext.broadcast(_inverted(own.select(F.col("query_id").cast("long"), "tokens").toArrow()))
        given = prepared(sent)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = sent.value
            q = len(asked.ids)
            best = Best(settings * q, k)
            for whole in batches:
                for at in range(0, whole.num_rows if q else 0, step := max(1, CELLS // max(1, q))):
                    batch = whole.slice(at, step)
                    ids = batch["doc_id"].to_numpy()
                    dl = pc.fill_null(pc.list_value_length(batch["tokens"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                    row, term, tf = _counted(batch["tokens"], asked.terms)
                    n, cell = _cells(row, term, asked)
                    for j, w in enumerate(weights(given, term, tf, dl[row])):
                        value = np.bincount(cell, np.repeat(w, n), minlength=len(ids) * q)
                        hit = np.flatnonzero(value)
                        score = rounded(value[hit], asked.sizes[hit % q])
                        fit = score >= best.floor[j * q + hit % q]
                        hit, score = hit[fit], score[fit]
                        best.add(j * q + hit % q, score, ids[hit // q], value[hit], dl[hit // q])
            who = best.key % max(1, q)
            yield pa.RecordBatch.from_arrays([pa.array(best.key // max(1, q)), pa.array(asked.ids[who]), pa.array(asked.sizes[who]), pa.array(best.doc), pa.array(best.size), pa.array(best.value)], names=["setting", "query_id", "q_n", "doc_id", "dl", "value"])

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "tokens").mapInArrow(run, "setting long, query_id long, q_n long, doc_id long, dl long, value double"), sent

    return D._pass_by_pass(one, passes)


def bm25_settings(queries: DataFrame, docs: DataFrame, grid: list[tuple[float, float]], k: int) -> DataFrame:
    """(setting, query_id, doc_id, value): every query's k best of every task by BM25, for each (k1, b) of a grid. Two scans."""

    def weights(given: tuple, term: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> list[np.ndarray]:
        df, n_docs, avgdl = given
        weight = np.log(1 + (n_docs - df[term] + 0.5) / (df[term] + 0.5)) * tf
        return [weight / (tf + k1 * (1 - b + b * dl / avgdl)) for k1, b in grid]

    return _search(queries, docs, k, len(grid), lambda sent: _statistics(docs, sent), weights, lambda x, _: half_up(x)).select("setting", "query_id", "doc_id", "value")


def overlap(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, q_n, doc_id, d_n, both_n): every query's k documents of most terms in common, of every task. docs: doc_id, tokens, distinct."""
    out = _search(queries, docs, k, 1, lambda _: None, lambda _, term, tf, dl: [np.ones(len(term))], lambda x, n: half_up(x / n))
    return out.select("query_id", "q_n", "doc_id", F.col("dl").alias("d_n"), F.col("value").cast("long").alias("both_n"))
