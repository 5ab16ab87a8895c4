"""What a search service asks for, as functions that return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexical as L


def search(catalog: DataFrame, text: str, k: int = 10) -> DataFrame:
    """(doc_id, title, score, rank) for a query string; punctuation never breaks it."""
    spark = catalog.sparkSession
    query = spark.createDataFrame([(0, text)], "query_id long, q string").select("query_id", T.query_tokens(F.col("q")).alias("tokens"))
    docs = catalog.select("doc_id", T.query_tokens(F.col("title")).alias("tokens"))
    top = L.top_k(L.bm25(query, docs), k)
    return catalog.select("doc_id", "title").join(top, "doc_id").select("doc_id", "title", F.round("score", 4).alias("score"), "rank").orderBy("rank")


def suggest(keys: DataFrame, prefix: str, limit: int = 8, expansions: dict[str, str] | None = None) -> DataFrame:
    """(key, tier): keys that start with the prefix, then with its long form, then with a word that does."""
    p = prefix.lower()
    q = next((v + p[len(a) :] for a, v in (expansions or {}).items() if p.startswith(a)), None)
    low = F.lower("key")
    tier = F.when(low.startswith(p), 1)
    tier = tier.when(low.startswith(q), 2) if q else tier
    tier = tier.when(low.contains(" " + p), 3)
    shown = keys.where(T.clean_suggestion(F.col("key"))).select("key", tier.alias("tier")).where("tier IS NOT NULL")
    return shown.distinct().orderBy("tier", "key").limit(limit)


def detail(catalog: DataFrame, doc_id: int) -> DataFrame:
    return catalog.where(F.col("doc_id") == doc_id)
