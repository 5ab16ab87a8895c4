"""Streams: an append-only ledger with running totals, and a feed that keeps the latest of each key.

Sources are folders of files; each query has a checkpoint, so a restart goes on where the
last one stopped, and runs until what is available is done.
"""

from __future__ import annotations

import signal
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def totals(events: DataFrame) -> DataFrame:
    """Running number and cost by provider and model."""
    return events.groupBy("provider", "model").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))


def run_totals(events: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Totals as an in-memory table; each batch replaces it whole."""
    return totals(events).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert(target: str, keys: list[str], order: str, removed: str | None = None):
    """For foreachBatch: the latest row of each key, written as a new version of the table per batch.

    Batch n reads version n - 1 and writes version n, so a batch that is run again gives
    the same version.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        best = lambda df: df.groupBy(*keys).agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")
        new = best(batch)
        if n > 0:
            new = best(new.unionByName(spark.read.schema(batch.schema).parquet(f"{target}/{n - 1}")))
        new.write.mode("overwrite").parquet(f"{target}/{n}")

    def current(spark: SparkSession, n: int, schema) -> DataFrame:
        x = spark.read.schema(schema).parquet(f"{target}/{n}")
        return x.where(~F.col(removed)) if removed else x

    step.current = current
    return step


def watched(df: DataFrame, name: str, **checks) -> DataFrame:
    """df with metrics that the listener gets per batch, for early warnings."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(k) for k, c in checks.items()))


def score_batches(scorer):
    """For mapInPandas: batches of 32 pairs go to a scorer, with a last smaller one."""

    def run(frames):
        for pdf in frames:
            for at in range(0, len(pdf), 32):
                part = pdf.iloc[at : at + 32]
                yield part.assign(score=scorer(part["query"].tolist(), part["text"].tolist()))

    return run


def stop_on_signal(query: StreamingQuery, *signals: signal.Signals) -> None:
    """Stop a stream when the process is asked to end (SIGTERM unless others are named).

    The signal only starts a thread, which stops the query between batches' tasks; what is
    not committed then is done again from the checkpoint. To be called in the main thread.
    """
    for s in signals or (signal.SIGTERM,):
        signal.signal(s, lambda *_: threading.Thread(target=query.stop, daemon=True).start())
