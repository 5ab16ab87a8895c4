"""Streams over the event table, run until all that is there is done, against batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import ledger
from ..operators.storage import shared_folder
from .registry import Tables, query


def shared(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/sieveline/{name}-{uuid.uuid4().hex}"


def events(t: Tables) -> DataFrame:
    """The event table as a stream of files."""
    folder = t.sf_dir if t.events.inputFiles()[0].endswith("/events.parquet") else f"{t.sf_dir}/events.parquet"
    stream = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1)
    return (stream.option("pathGlobFilter", "events.parquet") if folder == t.sf_dir else stream).parquet(folder)


@query("SELECT event_type AS provider, user_id % 5 AS model, count(*) AS n, round(sum(value), 2) AS cost FROM events GROUP BY ALL")
def st4_ledger_stream(t: Tables) -> DataFrame:
    name = f"ledger_{uuid.uuid4().hex}"
    rows = events(t).select(F.col("event_type").alias("provider"), (F.col("user_id") % 5).alias("model"), F.col("value").alias("cost"))
    ledger.run_totals(rows, name, shared(t, "ledger")).awaitTermination()
    return t.spark.table(name).select("provider", "model", "n", F.round("cost", 2).alias("cost"))


@query("SELECT user_id, event_id, event_type FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'")
def st5_latest_per_key_stream(t: Tables) -> DataFrame:
    """The last event of each user, without those that withdraw it."""
    rows = events(t).select("user_id", "event_id", "event_type", (F.col("event_type") == "error").alias("removed"))
    at = shared(t, "latest")
    step = ledger.upsert(f"{at}/table", ["user_id"], "event_id", "removed")
    q = rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress["batchId"] if q.lastProgress else 0
    return step.current(t.spark, last, rows.schema).select("user_id", "event_id", "event_type")
