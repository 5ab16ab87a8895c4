"""What the operators of this subpackage share: reading tables, shared storage, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs in one JVM, as in tests.
LOCAL_SHARED = "/tmp/checkpoints"
#: Bytes that a Python worker turns into Python objects at once, if rows are of one size.
PART_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; an error on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_SHARED).rstrip("/")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like these that are no column of df, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Tables that one operator call writes to the shared folder to cut lineage.

    A lost executor costs no recomputation of what is written. `drop` removes a table
    that no later plan reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/sieveline/{label}-{uuid.uuid4().hex}"
        self.made = 0

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.made}"
        self.made += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at PART_BYTES too, not at a number of rows only, unless the session says otherwise.

    A batch of 10,000 long texts would stand several times in the JVM and in the Python worker.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, str(PART_BYTES))


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def map_batches(df: DataFrame, f: Callable[[dict], dict | None], schema: str, setup: Callable[[], dict] | None = None) -> DataFrame:
    """Run f on parts of Arrow batches of about PART_BYTES: columns as lists in, columns as lists out.

    setup runs once per task; what it returns is passed on as keyword arguments.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    bounded_batches(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extra = setup() if setup else {}
        for b in batches:
            rows = max(1, b.num_rows * PART_BYTES // max(1, b.nbytes))
            for at in range(0, b.num_rows, rows):
                if (out := f(b.slice(at, rows).to_pydict(), **extra)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[c.name], c.type) for c in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def worker_cache(owner: str) -> dict:
    """A dictionary that outlives tasks in a Python worker; one operator has it at a time, so caches don't add up."""
    import sys
    import types

    held = sys.modules.setdefault("_sieveline_worker", types.ModuleType("_sieveline_worker")).__dict__
    if held.get("owner") != owner:
        held["owner"], held["cache"] = owner, {}
    return held["cache"]
