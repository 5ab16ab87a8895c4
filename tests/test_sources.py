"""Readers and writers, round trips and what they leave out."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from sieveline.sources import io, serving
from sieveline.streaming import ledger


def test_json_lines(spark, tmp_path):
    p = tmp_path / "q.jsonl.gz"
    with gzip.open(p, "wt") as f:
        f.write('{"query_id": "1", "query": "a"}\nnot json\n{"query_id": "2"}\n')
    assert {r["query_id"] for r in io.json_lines(spark, str(p), io.QUERY, tolerant=True).collect()} == {"1", "2"}
    with pytest.raises(Exception, match="."):
        io.json_lines(spark, str(p), io.QUERY).collect()


def test_qrels_of_either_field(spark, tmp_path):
    p = tmp_path / "qrels.jsonl"
    p.write_text('{"query_id": "1", "product_id": "a", "relevance": 1}\n{"query_id": "1", "product_id": "a", "relevance": 3}\n{"query_id": "1", "doc_id": "b", "relevance": 0}\n')
    assert sorted(map(tuple, io.qrels(spark, str(p)).collect())) == [("1", "a", 3), ("1", "b", 0)]


def test_parallel_arrays(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps(["x", "y"]))
    (tmp_path / "t.json").write_text(json.dumps(["one", "two"]))
    (tmp_path / "bad.json").write_text(json.dumps(["one"]))
    assert [tuple(r) for r in io.parallel_arrays(spark, str(tmp_path / "i.json"), str(tmp_path / "t.json")).collect()] == [(0, "x", "one"), (1, "y", "two")]
    with pytest.raises(Exception, match="."):
        io.parallel_arrays(spark, str(tmp_path / "i.json"), str(tmp_path / "bad.json")).collect()


def test_tsv(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text('id\ttitle\tyear\n1\t"Quoted" one\t1990\n2\t\\N\t\\N\n')
    assert [tuple(r) for r in io.tsv(spark, str(p), "id string, title string, year int").collect()] == [("1", '"Quoted" one', 1990), ("2", None, None)]


def test_csv_round_trip(spark, tmp_path):
    rows = [("a,b", 'say "x"'), ("line\nbreak", "")]
    df = spark.createDataFrame(rows, "slug string, text string")
    for tab in (False, True):
        io.write_csv(df, str(tmp_path / f"c{tab}"), tab, quote_all=True)
    back = io.csv(spark, str(tmp_path / "cFalse"), "slug string, text string").fillna("")
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_products_xml(spark, tmp_path):
    p = tmp_path / "p.xml"
    cat = lambda *n: "<categoryPath>" + "".join(f"<category><id>{i}</id><name>{x}</name></category>" for i, x in enumerate(n)) + "</categoryPath>"
    p.write_text(f"<products><product><sku>1</sku><name>First &amp; best</name>{cat('Root', 'A', 'B', 'C', 'D')}</product><product><sku>1</sku><name>Second</name>{cat('Root')}</product></products>")
    assert [tuple(r) for r in io.products(spark, str(p)).collect()] == [("1", "First & best", "D", "B > C > D")]


def test_writers(spark, tmp_path):
    df = spark.range(100).repartition(1)
    io.write_parquet(df, str(tmp_path / "p"), 30)
    assert len(list((tmp_path / "p").glob("*.parquet"))) == 4
    io.write_json(df.limit(3), str(tmp_path / "j"))
    io.write_json(df.limit(2), str(tmp_path / "j"), append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 5
    for n in (5, 7):
        io.install(spark.range(n), str(tmp_path / "t"))
        assert spark.read.parquet(str(tmp_path / "t")).count() == n
    assert not (tmp_path / "t.old").exists() and not (tmp_path / "t.new").exists()


def test_pending_grades_and_jobs(spark):
    assert io.pending(spark.range(5), spark.range(3), ["id"]).count() == 2
    x = spark.createDataFrame([("Exact",), ("Substitute",), ("C",), ("Irrelevant",), ("?",)], "label string")
    assert [r["grade"] for r in io.graded_labels(x).collect()] == [3, 2, 1, 0, None]
    j = io.jobs(spark.createDataFrame([("1", "Cook", "100")], "id string, title string, salary_min string"), "board").first()
    assert (j["title"], j["salary_min"], j["source"], j["remote"]) == ("Cook", 100.0, "board", None)


def test_serving(spark):
    catalog = spark.createDataFrame([(1, "red ring"), (2, "blue bolt"), (3, "red bolt")], "doc_id long, title string")
    found = serving.search(catalog, "red (bolt)!", 2).collect()
    assert found[0].asDict().keys() == {"doc_id", "title", "score", "rank"} and found[0]["title"] == "red bolt"
    keys = spark.createDataFrame([("registered nurse",), ("rn lead",), ("staff rn",), ("99999999",)], "key string")
    assert [r["key"] for r in serving.suggest(keys, "RN", expansions={"rn": "registered nurse"}).collect()] == ["rn lead", "registered nurse", "staff rn"]
    assert serving.detail(catalog, 2).first()["title"] == "blue bolt"


def test_stream_resumes(spark, tmp_path):
    schema = "provider string, model long, cost double"
    src, seen = str(tmp_path / "src"), []
    for part in ([("a", 1, 1.0), ("a", 1, 2.0)], [("b", 1, 5.0)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(src)
        q = ledger.read(spark, src, schema).writeStream.foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r["cost"] for r in seen) == [1.0, 2.0, 5.0]


def test_scorer_batches(spark):
    sizes = spark.createDataFrame([("q", f"t{i}") for i in range(70)], "query string, text string").coalesce(1)
    out = sizes.mapInPandas(ledger.score_batches(lambda q, t: [float(len(t))] * len(q)), "query string, text string, score double")
    assert out.count() == 70 and out.agg(F.max("score")).first()[0] <= 32


def test_observed_metrics(spark):
    from pyspark.sql import Observation

    seen = Observation("early")
    spark.range(10).observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("id") > 7).alias("late")).collect()
    assert seen.get == {"rows": 10, "late": 2}
