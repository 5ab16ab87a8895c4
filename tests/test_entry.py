"""The driver's contract, with and without the training-data operators."""

import os
import subprocess
import sys

import __spark_entry__ as E

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["query_id", "doc_id", "score", "rank"]


def test_sql_belongs_to_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_works_without_the_extra(tmp_path):
    code = "import sys; sys.modules['sieveline.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'r2_bm25_topk' in q and not any(n.startswith('op') and n[2].isdigit() for n in q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr


def test_nothing_else_imports_the_extra():
    for folder, _, files in os.walk(os.path.join(ROOT, "sieveline")):
        for f in files:
            if f.endswith(".py") and os.sep + "llm" not in folder:
                assert "llm" not in open(os.path.join(folder, f)).read(), f
