"""Inverted-index retrieval: statistics, BM25, boolean matching with relaxation, spelling.

A collection that is asked often has a stored index: postings sorted by term, with the
terms' and the collection's statistics beside them, built once. For one call, postings are
only built for the terms that its queries ask for: tokens are filtered by the query
vocabulary before they are counted, so what is shuffled follows the matches and not the
corpus. The vocabulary side is small and left to the optimizer to broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def document_frequency(docs: DataFrame, tokens: Column) -> DataFrame:
    """(term, df): documents that have the term."""
    return docs.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def collection_frequency(docs: DataFrame, tokens: Column, least: int = 2) -> DataFrame:
    """(term, cf) of terms that occur at least so often."""
    return docs.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count("*").alias("cf")).where(F.col("cf") >= least)


def idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (F.coalesce(df, F.lit(0)) + 1))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, tf, dl) for the given terms. docs: doc_id, tokens.

    Besides, each document has one posting of the empty term, which no query asks for: so
    sizes of the collection come from the same scan and the same shuffle as the postings.
    """
    asked = terms.select("term").distinct().union(terms.sparkSession.createDataFrame([("",)], "term string"))
    each = docs.select("doc_id", F.size("tokens").alias("dl"), F.explode(F.concat("tokens", F.array(F.lit("")))).alias("term")).where(F.col("term").isNotNull())
    return each.join(asked, "term").groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))


def collection(post: DataFrame) -> DataFrame:
    """One row: n_docs and avgdl. All columns are named, so that the plan below is the postings' own and is run once."""
    whole = (F.col("term") == "") & (F.col("tf") > 0)
    return post.agg(F.count_if(whole).alias("n_docs"), F.avg(F.when(whole, F.col("dl"))).alias("avgdl"))


def posting_df(post: DataFrame) -> DataFrame:
    """(term, df) of postings, over the same shuffle."""
    return post.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))


@dataclass
class Index:
    """A stored collection. postings: term, doc_id, dl, tf; terms: term, df, cf; sizes: one row of n_docs and avgdl."""

    postings: DataFrame
    terms: DataFrame
    sizes: DataFrame


def build_index(docs: DataFrame, path: str) -> None:
    """Write the index of docs (doc_id, tokens). A frequent term's postings are split by doc_id."""
    spark = docs.sparkSession
    each = docs.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    counted = each.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    counted.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).write.mode("overwrite").parquet(f"{path}/terms")
    docs.agg(F.count("*").alias("n_docs"), F.avg(F.size("tokens")).alias("avgdl")).write.mode("overwrite").parquet(f"{path}/sizes")


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "sizes")))


def hits(queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, doc_id, term, tf, dl, df, n_docs, avgdl) of the queries' distinct terms; no text is read."""
    asked = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("term")).join(index.terms.select("term", "df"), "term")
    return index.postings.join(asked, "term").crossJoin(F.broadcast(index.sizes))


def bm25_stored(queries: DataFrame, index: Index, k1: float = 0.3, b: float = 0.6) -> DataFrame:
    """As `bm25`, from a stored index."""
    return hits(queries, index).groupBy("query_id", "doc_id").agg(F.sum(weighted_tf(F.lit(k1), F.lit(b))).alias("score"))


def weighted_tf(k1: Column, b: Column) -> Column:
    weight = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return weight * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


def bm25(queries: DataFrame, docs: DataFrame, k1: float = 0.3, b: float = 0.6) -> DataFrame:
    """(query_id, doc_id, score). queries: query_id, tokens; docs: doc_id, tokens.

    Each distinct query term adds ln(1 + (N - df + .5) / (df + .5)) tf / (tf + k1 (1 - b + b dl / avgdl)).
    """
    terms = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("term"))
    post = postings(docs, terms)
    scored = post.join(posting_df(post), "term").crossJoin(F.broadcast(collection(post))).join(terms, "term")
    return scored.groupBy("query_id", "doc_id").agg(F.sum(weighted_tf(F.lit(k1), F.lit(b))).alias("score"))


def expanded(docs: DataFrame, given: DataFrame) -> DataFrame:
    """docs (doc_id, tokens) with the tokens of all texts given for them (doc_id, tokens) behind their own."""
    more = given.groupBy("doc_id").agg(F.flatten(F.collect_list("tokens")).alias("more"))
    return docs.join(more, "doc_id", "left").select("doc_id", F.concat("tokens", F.coalesce("more", F.array().cast("array<string>"))).alias("tokens"))


def bm25_best(queries: DataFrame, docs: DataFrame, given: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): the best of a document's score and of those of the texts given for it, which are a collection of their own."""
    place = Window.partitionBy("doc_id").orderBy("tokens")
    each = given.withColumn("doc_id", F.struct("doc_id", F.row_number().over(place).alias("n")))
    own = bm25(queries, docs)
    other = bm25(queries, each).select("query_id", F.col("doc_id.doc_id").alias("doc_id"), "score")
    return own.unionByName(other).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def top_k(scored: DataFrame, k: int, by: str = "score", digits: int = 6) -> DataFrame:
    """The best k per query with `rank` from 1; scores are rounded first and ties go by doc_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by), "doc_id")
    return scored.withColumn(by, F.round(by, digits)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def combos(tokens: Column) -> Column:
    """All non-empty subsets of a token array in combination order: array<struct<mask, size, words>>.

    The subset of bit i set holds token i; subsets of one size are ordered as positions compare.
    """
    masks = F.sequence(F.lit(1), F.pow(F.lit(2.0), F.size(tokens)).cast("int") - 1)
    words = lambda m: F.filter(tokens, lambda _, i: F.floor(m / F.pow(F.lit(2.0), i)) % 2 == 1)
    return F.transform(masks, lambda m: F.struct(m.alias("mask"), F.bit_count(m).alias("size"), words(m).alias("words")))


def correct(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, correction): the most frequent vocabulary term at the smallest distance of 1 or 2.

    words: word; vocabulary: term, cf. Words in the vocabulary, of at most 2 letters or
    with a digit stay. Candidates meet by shared deletion signatures (each side with up to
    two letters left out), an equi-join in place of a comparison of all pairs.
    """
    ask = words.select("word").distinct().where((F.length("word") > 2) & ~F.col("word").rlike("[0-9]")).join(vocabulary, F.col("word") == F.col("term"), "left_anti")
    without = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    less = lambda w: F.array_distinct(F.concat(F.array(w), without(w), F.flatten(F.transform(without(w), lambda x: F.when(F.length(x) > 0, without(x)).otherwise(F.array(x))))))
    a = ask.select("word", F.explode(less(F.col("word"))).alias("signature"))
    v = vocabulary.select("term", "cf", F.explode(less(F.col("term"))).alias("signature"))
    near = a.join(v, "signature").select("word", "term", "cf").distinct().withColumn("distance", F.levenshtein("word", "term")).where("distance <= 2")
    best = Window.partitionBy("word").orderBy("distance", F.desc("cf"), "term")
    return near.withColumn("n", F.row_number().over(best)).where("n = 1").select("word", F.col("term").alias("correction"), "distance")
