"""Readers and writers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

JOB = "id string, source_slug string, title string, description_html string, department string, employment_type string, remote boolean, locations array<string>, salary_min double, salary_max double, salary_currency string, posted_at string, source string"
BAG = "query string, num_results int, query_vector array<float>, specificity double, results array<struct<title:string,ce_score:double>>, hardnegs array<string>"
QUERY = "query_id string, query string, source string"
QRELS = "query_id string, product_id string, doc_id string, relevance int"


def json_lines(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """One object per line, also compressed. tolerant: lines that are no JSON are left out; else they fail."""
    if not tolerant:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    kind = T._parse_datatype_string(schema).add("__bad", T.StringType())
    return spark.read.schema(kind).option("columnNameOfCorruptRecord", "__bad").json(path).where(F.col("__bad").isNull()).drop("__bad")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, grade), whichever of the two id fields a line has; of repeated pairs the highest grade."""
    x = json_lines(spark, path, QRELS).select("query_id", F.coalesce("doc_id", "product_id").alias("doc_id"), F.col("relevance").alias("grade"))
    return x.groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))


def parallel_arrays(spark: SparkSession, ids: str, titles: str) -> DataFrame:
    """(pos, id, title) of two JSON arrays that belong together; fails if their lengths differ."""
    one = lambda p, n: spark.read.text(p, wholetext=True).select(F.from_json("value", "array<string>").alias(n))
    both = one(ids, "i").crossJoin(one(titles, "t"))
    checked = both.select(F.when(F.size("i") == F.size("t"), F.arrays_zip("i", "t")).otherwise(F.raise_error(F.lit("ids and titles differ in number"))).alias("z"))
    return checked.select(F.posexplode("z").alias("pos", "x")).select("pos", F.col("x.i").alias("id"), F.col("x.t").alias("title"))


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated with header, without quoting, \\N for null; short rows are left out."""
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("header", True).option("nullValue", "\\N").option("mode", "DROPMALFORMED").csv(path)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, keep: str | None = None, recursive: bool = False) -> DataFrame:
    """Only these columns and rows reach the plan above the scan."""
    x = spark.read.option("recursiveFileLookup", recursive).parquet(path)
    x = x.where(keep) if keep else x
    return x.select(*columns) if columns else x


def xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def products(spark: SparkSession, path: str) -> DataFrame:
    """(sku, name, leaf, path): the first name of each sku, its deepest category and the last three below the root."""
    x = xml(spark, path, "product", "sku string, name string, categoryPath struct<category:array<struct<id:string,name:string>>>")
    x = x.withColumn("at", F.monotonically_increasing_id())
    names = F.transform("categoryPath.category", lambda c: c["name"])
    first = x.withColumn("n", F.row_number().over(Window.partitionBy("sku").orderBy("at"))).where("n = 1")
    below = F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0)))
    last3 = F.slice(below, F.greatest(F.size(below) - 2, F.lit(1)), F.lit(3))
    return first.select("sku", "name", F.try_element_at(names, F.lit(-1)).alias("leaf"), F.array_join(last3, " > ").alias("path"))


def graded_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds `grade`: Exact 3, Substitute 2, Complement 1, Irrelevant 0, by first letter."""
    of = F.create_map(*(F.lit(x) for pair in {"E": 3, "S": 2, "C": 1, "I": 0}.items() for x in pair))
    return df.withColumn("grade", of[F.substring(label, 1, 1)])


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "errorifexists").json(path)


def write_parquet(df: DataFrame, path: str, rows_per_file: int = 25_000) -> None:
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_csv(df: DataFrame, path: str, tab: bool = False, quote_all: bool = False) -> None:
    df.write.option("header", True).option("sep", "\t" if tab else ",").option("quoteAll", quote_all).option("escape", '"').csv(path)


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What an earlier run has not written yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def install(df: DataFrame, path: str) -> None:
    """Write beside the target, then swap it in; the former one stays as a backup until the swap is done."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, fresh, old = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + x) for x in ("", ".new", ".old"))
    fs = target.getFileSystem(conf)
    df.write.mode("overwrite").parquet(fresh.toString())
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(fresh, target):
        fs.rename(old, target)
        raise OSError(f"cannot install {path}")
    fs.delete(old, True)


def jobs(raw: DataFrame, source: str) -> DataFrame:
    """Postings of any source in the common schema; fields that a source lacks are null."""
    kind = T._parse_datatype_string(JOB)
    have = {f.name for f in raw.schema}
    return raw.select(*((F.col(f.name) if f.name in have else F.lit(source) if f.name == "source" else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind))


def matrix(spark: SparkSession, path: str, rows_per_part: int = 50_000) -> DataFrame:
    """(row_id, v): the rows of a .npy matrix, read by ranges through a memory map.

    The file must stand under this path on the driver, which reads its header, and on all
    executors, as on a shared mount; convert it to Parquet once for repeated use.
    """
    import numpy as np
    import pyarrow as pa

    shape = np.load(path, mmap_mode="r").shape
    if len(shape) != 2:
        raise ValueError(f"{path} has {len(shape)} dimensions, not 2")

    def run(batches):
        for b in batches:
            for first in b["id"].to_pylist():
                part = np.load(path, mmap_mode="r")[first * rows_per_part : (first + 1) * rows_per_part].astype(np.float32)
                ids = pa.array(np.arange(first * rows_per_part, first * rows_per_part + len(part)))
                v = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, max(1, shape[1]), dtype=np.int32)[: len(part) + 1]), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([ids, v], names=["row_id", "v"])

    parts = -(-shape[0] // rows_per_part)
    return spark.range(0, parts, 1, max(1, parts)).mapInArrow(run, "row_id long, v array<float>")
