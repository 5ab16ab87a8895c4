"""Late interaction: a query's parts each take their best match among a document's parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dense import _matrix, _pass_by_pass, _passes


def max_sim(queries: DataFrame, vectors: DataFrame, parts: int, k: int) -> DataFrame:
    """Top k by Σ over query parts of the largest dot product with a document part. Queries beyond `QUERY_BYTES` go in passes."""
    passes = _passes(queries)

    def one(i: int) -> tuple[DataFrame, Broadcast]:
        own = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)
        return _one_pass(own, vectors, parts, k)

    found = _pass_by_pass(one, passes)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)


def _one_pass(queries: DataFrame, vectors: DataFrame, parts: int, k: int) -> tuple[DataFrame, Broadcast]:
    rows = queries.select(F.col("query_id").cast("long"), F.col("v").cast("array<double>")).toArrow()
    sent = vectors.sparkSession.sparkContext.broadcast((rows["query_id"].to_numpy(), _matrix(rows["v"].combine_chunks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        q = q.reshape(len(ids), parts, -1) if len(ids) else q
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            docs, d = batch["doc_id"].to_numpy(), _matrix(batch["v"]).reshape(batch.num_rows, parts, -1)
            out: list = [[], [], []]
            for i, own in zip(ids, q, strict=True):
                s = np.round(np.einsum("pe,dre->dpr", own, d).max(axis=2).sum(axis=1), 6)
                cut = np.lexsort((docs, -s))
                cut = cut[docs[cut] != i][:k]
                out[0] += [i] * len(cut)
                out[1] += docs[cut].tolist()
                out[2] += s[cut].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "doc_id", "score"])

    return vectors.select(F.col("doc_id").cast("long"), F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "query_id long, doc_id long, score double"), sent
