"""Fusion queries over three runs: the whole vector and its two halves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fusion as U
from ..operators import lexical as L
from .dense import PAIRS, rescored, run, run_sql
from .lexical import DOCS, QUERIES, asked, bm25_sql, docs
from .registry import Tables, query

RUNS = f"WITH {PAIRS}, {run_sql('a', 's', 50)}, {run_sql('b', 's1', 50)}, {run_sql('c', 's2', 50)}"
ALL = "u AS (SELECT 0 AS stream, query_id, doc_id, score, rank FROM a UNION ALL SELECT 1, query_id, doc_id, score, rank FROM b UNION ALL SELECT 2, query_id, doc_id, score, rank FROM c)"


def best(source: str, k: int = 10, by: str = "score DESC", digits: int = 6) -> str:
    return f"SELECT query_id, doc_id, round(score, {digits}) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round({by.split()[0]}, {digits}) {' '.join(by.split()[1:])}, doc_id) AS rank FROM {source} QUALIFY rank <= {k}"


def runs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(run(t, 50, i) for i in range(3))


def scores(t: Tables) -> DataFrame:
    """The pool of the first run with the three scores of each document (null beyond a run's depth)."""
    a, b, c = runs(t)
    return U.wide(a, b, c).where(F.col("s0").isNotNull())


POOL = "p AS (SELECT a.query_id, a.doc_id, a.score AS s0, b.score AS s1, c.score AS s2 FROM a LEFT JOIN b USING (query_id, doc_id) LEFT JOIN c USING (query_id, doc_id))"


def mm(c: str, eps: float = 1e-8) -> str:
    return f"(({c} - min({c}) OVER (PARTITION BY query_id)) / greatest(max({c}) OVER (PARTITION BY query_id) - min({c}) OVER (PARTITION BY query_id), {eps}))"


@query(f"{RUNS}, {ALL}, f AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score FROM u GROUP BY ALL) {best('f')}")
def f1_rrf(t: Tables) -> DataFrame:
    return U.ranked(U.rrf(*runs(t)), 10)


@query(f"{RUNS}, {ALL}, f AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank - 1)) AS score FROM u GROUP BY ALL) {best('f')}")
def f1b_rrf_zero_based(t: Tables) -> DataFrame:
    return U.ranked(U.rrf(*runs(t), first=0), 10)


@query(f"{RUNS}, {ALL}, f AS (SELECT query_id, doc_id, CAST(sum(rank) + 100 * (3 - count(*)) AS DOUBLE) AS score FROM u GROUP BY ALL) {best('f', by='score ASC')}")
def f2_sumrank(t: Tables) -> DataFrame:
    return U.ranked(U.rank_sum(*runs(t)), 10, up=True)


@query(f"WITH {PAIRS}, {run_sql('a', 's', 50)}, f AS (SELECT query_id, doc_id, (s + s1 + s2) / 3 AS score FROM pairs JOIN (SELECT query_id, doc_id FROM a) USING (query_id, doc_id)) {best('f')}")
def f3_sumsim(t: Tables) -> DataFrame:
    pool = run(t, 50).select("query_id", "doc_id", F.col("score").alias("s0"))
    full = [rescored(t, pool, i).withColumnRenamed("score", f"s{i}") for i in (1, 2)]
    x = pool.join(full[0], ["query_id", "doc_id"]).join(full[1], ["query_id", "doc_id"])
    return U.ranked(x.select("query_id", "doc_id", ((F.col("s0") + F.col("s1") + F.col("s2")) / 3).alias("score")), 10)


@query(f"""{RUNS}, {POOL}, n AS (SELECT query_id, doc_id, {mm('s0')} AS x0, {mm('s1')} AS x1, {mm('s2')} AS x2 FROM p),
f AS (SELECT query_id, doc_id, (coalesce(.4 * x0, 0) + coalesce(.2 * x1, 0) + coalesce(.4 * x2, 0)) / (CASE WHEN x0 IS NULL THEN 0 ELSE .4 END + CASE WHEN x1 IS NULL THEN 0 ELSE .2 END + CASE WHEN x2 IS NULL THEN 0 ELSE .4 END) AS score FROM n) {best('f')}""")
def f4_minmax_wsum(t: Tables) -> DataFrame:
    return U.ranked(U.weighted(scores(t), {"s0": 0.4, "s1": 0.2, "s2": 0.4}), 10)


@query(f"""{RUNS}, w AS (SELECT query_id, doc_id, coalesce(a.score, 0) AS s0, coalesce(b.score, 0) AS s1 FROM a FULL JOIN b USING (query_id, doc_id)), f AS (SELECT query_id, doc_id, .5 * {mm('s0', 1e-9)} + .5 * {mm('s1', 1e-9)} AS score FROM w) {best('f')}""")
def f5_union_wsum(t: Tables) -> DataFrame:
    a, b, _ = runs(t)
    x = U.wide(a, b, missing=0.0)
    return U.ranked(x.select("query_id", "doc_id", (0.5 * U.min_max("s0", 1e-9) + 0.5 * U.min_max("s1", 1e-9)).alias("score")), 10)


@query(f"{RUNS}, f AS (SELECT a.query_id, a.doc_id, s1 AS score FROM a JOIN (SELECT query_id, doc_id, s1 FROM pairs) USING (query_id, doc_id)) {best('f')}")
def f6_cascade(t: Tables) -> DataFrame:
    """The pool of one run in the order of another's scores."""
    return U.ranked(rescored(t, run(t, 50), 1), 10)


@query(f"""{RUNS}, {POOL}, n AS (SELECT query_id, doc_id, {mm('s0')} AS x0, coalesce({mm('s1')}, 0) AS x1, coalesce({mm('s2')}, 0) AS x2 FROM p),
g AS (SELECT i, j, 10 - i - j AS k FROM range(11) x(i), range(11) y(j) WHERE i + j <= 10),
r AS (SELECT i, j, k, query_id, doc_id, row_number() OVER (PARTITION BY i, j, query_id ORDER BY round((i * x0 + j * x1 + k * x2) / 10.0, 6) DESC, doc_id) AS rank FROM n, g QUALIFY rank <= 10)
SELECT CAST(i AS INTEGER) AS w0, CAST(j AS INTEGER) AS w1, CAST(k AS INTEGER) AS w2, round(avg(CASE WHEN q.label = d.label THEN 1.0 ELSE 0.0 END), 6) AS precision_10 FROM r JOIN embeddings q ON q.vec_id = query_id JOIN embeddings d ON d.vec_id = doc_id GROUP BY ALL""")
def f7_weight_grid(t: Tables) -> DataFrame:
    x = scores(t).select("query_id", "doc_id", U.min_max("s0").alias("x0"), F.coalesce(U.min_max("s1"), F.lit(0.0)).alias("x1"), F.coalesce(U.min_max("s2"), F.lit(0.0)).alias("x2"))
    grid = F.explode(F.array(*(F.struct(F.lit(i).alias("w0"), F.lit(j).alias("w1"), F.lit(10 - i - j).alias("w2")) for i in range(11) for j in range(11 - i)))).alias("g")
    s = x.select("*", grid).select("*", "g.*").withColumn("score", F.round((F.col("w0") * F.col("x0") + F.col("w1") * F.col("x1") + F.col("w2") * F.col("x2")) / 10.0, 6))
    top = s.withColumn("rank", F.row_number().over(Window.partitionBy("w0", "w1", "query_id").orderBy(F.desc("score"), "doc_id"))).where("rank <= 10")
    of = lambda a, b: t.embeddings.select(F.col("vec_id").alias(a), F.col("label").alias(b))
    hit = F.when(F.col("ql") == F.col("dl"), 1.0).otherwise(0.0)
    return top.join(of("query_id", "ql"), "query_id").join(of("doc_id", "dl"), "doc_id").groupBy("w0", "w1", "w2").agg(F.round(F.avg(hit), 6).alias("precision_10"))


def zs(c: str) -> str:
    return f"(CASE WHEN stddev_pop({c}) OVER (PARTITION BY query_id) > 1e-9 THEN ({c} - avg({c}) OVER (PARTITION BY query_id)) / stddev_pop({c}) OVER (PARTITION BY query_id) ELSE 0 END)"


@query(f"WITH {PAIRS}, {run_sql('a', 's', 50)}, p AS (SELECT a.query_id, a.doc_id, s AS s0, s1 FROM a JOIN (SELECT query_id, doc_id, s, s1 FROM pairs) USING (query_id, doc_id)), f AS (SELECT query_id, doc_id, .7 * {zs('s0')} + .3 * {zs('s1')} AS score FROM p) {best('f', digits=5)}")
def f8_zscore(t: Tables) -> DataFrame:
    pool = run(t, 50).select("query_id", "doc_id", F.col("score").alias("s0"))
    x = pool.join(rescored(t, pool, 1).withColumnRenamed("score", "s1"), ["query_id", "doc_id"])
    return U.ranked(x.select("query_id", "doc_id", (0.7 * U.z_score("s0") + 0.3 * U.z_score("s1")).alias("score")), 10, digits=5)


@query(f"{RUNS}, {POOL}, f AS (SELECT query_id, doc_id, greatest(s0, coalesce(s1, -1), coalesce(s2, -1)) AS score FROM p) {best('f')}")
def f9_max(t: Tables) -> DataFrame:
    return U.ranked(scores(t).select("query_id", "doc_id", F.greatest("s0", F.coalesce("s1", F.lit(-1.0)), F.coalesce("s2", F.lit(-1.0))).alias("score")), 10)


@query(f"{RUNS}, g AS (SELECT a.query_id, a.doc_id, row_number() OVER (PARTITION BY a.query_id ORDER BY CASE WHEN b.score > 0 THEN 0 ELSE 1 END, a.rank) AS rank FROM a LEFT JOIN b USING (query_id, doc_id)) SELECT query_id, doc_id, rank FROM g WHERE rank <= 10")
def f10_gate(t: Tables) -> DataFrame:
    a, b, _ = runs(t)
    x = a.join(b.select("query_id", "doc_id", F.col("score").alias("other")), ["query_id", "doc_id"], "left")
    return U.gate(x, F.coalesce(F.col("other") > 0, F.lit(False))).where("rank <= 10").select("query_id", "doc_id", "rank")


MODES = ("dense", "half", "rrf", "cascade")


def search(t: Tables, mode: str, k: int = 10) -> DataFrame:
    """Run the search mode of this name; an unknown one falls back to the dense run."""
    a, b, c = runs(t)
    plan = {"half": lambda: b, "rrf": lambda: U.ranked(U.rrf(a, b, c)), "cascade": lambda: U.ranked(b.join(a, ["query_id", "doc_id"], "left_semi"))}
    return plan.get(mode, lambda: a)().where(F.col("rank") <= k).select("query_id", "doc_id", "rank")


@query(f"""{RUNS}, {ALL}, f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM u GROUP BY ALL), k AS (SELECT b.query_id, b.doc_id, b.score FROM b JOIN (SELECT query_id, doc_id FROM a) USING (query_id, doc_id)),
m AS (SELECT 'dense' AS mode, query_id, doc_id, rank FROM a UNION ALL SELECT 'half', query_id, doc_id, rank FROM b UNION ALL SELECT 'rrf', query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) FROM f UNION ALL SELECT 'cascade', query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) FROM k) SELECT * FROM m WHERE rank <= 10""")
def f11_modes(t: Tables) -> DataFrame:
    from functools import reduce

    return reduce(DataFrame.unionByName, (search(t, m).select(F.lit(m).alias("mode"), "query_id", "doc_id", "rank") for m in MODES))


@query(f"{RUNS}, u AS (SELECT query_id, doc_id, list(DISTINCT n ORDER BY n) AS l FROM (SELECT query_id, doc_id, 'a' AS n FROM a UNION ALL SELECT query_id, doc_id, 'b' FROM b UNION ALL SELECT query_id, doc_id, 'c' FROM c) GROUP BY ALL) SELECT query_id, doc_id, array_to_string(l, ',') AS retrievers FROM u")
def j12_candidate_pool(t: Tables) -> DataFrame:
    names = F.transform(F.array_sort(F.collect_set("stream")), lambda i: F.element_at(F.array(*map(F.lit, "abc")), i + 1))
    return U.stack(*runs(t)).groupBy("query_id", "doc_id").agg(F.array_join(names, ",").alias("retrievers"))


@query(f"{RUNS} SELECT query_id, doc_id, coalesce(a.rank, 100) AS rank_a, coalesce(b.rank, 100) AS rank_b FROM a FULL JOIN b USING (query_id, doc_id)")
def j13_outer_rank_join(t: Tables) -> DataFrame:
    a, b, _ = runs(t)
    x = a.select("query_id", "doc_id", F.col("rank").alias("rank_a")).join(b.select("query_id", "doc_id", F.col("rank").alias("rank_b")), ["query_id", "doc_id"], "full")
    return x.select("query_id", "doc_id", F.coalesce("rank_a", F.lit(100)).alias("rank_a"), F.coalesce("rank_b", F.lit(100)).alias("rank_b"))


@query(f"{RUNS} SELECT query_id, doc_id FROM a INTERSECT SELECT query_id, doc_id FROM b")
def u3_intersect(t: Tables) -> DataFrame:
    a, b, _ = runs(t)
    return a.select("query_id", "doc_id").intersect(b.select("query_id", "doc_id"))


@query(f"{RUNS} SELECT query_id, doc_id FROM a EXCEPT SELECT query_id, doc_id FROM b")
def u4_except(t: Tables) -> DataFrame:
    a, b, _ = runs(t)
    return a.select("query_id", "doc_id").exceptAll(b.select("query_id", "doc_id"))


@query(f"{RUNS} SELECT query_id, doc_id FROM a UNION SELECT query_id, doc_id FROM b UNION SELECT query_id, doc_id FROM c")
def u1_union_runs(t: Tables) -> DataFrame:
    a, b, c = (x.select("query_id", "doc_id") for x in runs(t))
    return a.union(b).union(c).distinct()


@query("SELECT 'part' AS corpus, p_partkey AS id, p_name AS title FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name FROM customer")
def u2_union_corpora(t: Tables) -> DataFrame:
    pick = lambda x, n, p: x.select(F.lit(n).alias("corpus"), F.col(f"{p}key").alias("id"), F.col(f"{p[0]}_name").alias("title"))
    return pick(t.part, "part", "p_part").unionByName(pick(t.supplier, "supplier", "s_supp")).unionByName(pick(t.customer, "customer", "c_cust"))


@query(f"WITH {DOCS}, {QUERIES}, {bm25_sql(0.3, 0.6, 'd', 'q')}, a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored QUALIFY rank <= 20), j AS (SELECT query_id, doc_id, rank, len(list_intersect(list_distinct(q.tokens), d.tokens)) / greatest(len(list_distinct(list_concat(q.tokens, d.tokens))), 1) AS score FROM a JOIN q USING (query_id) JOIN d USING (doc_id)) SELECT query_id, doc_id, rank, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS reranked FROM j")
def f6b_text_cascade(t: Tables) -> DataFrame:
    """BM25 candidates in the order of a scorer that reads both texts."""
    d, q = docs(t), asked(t)
    pool = L.top_k(L.bm25(q, d), 20).select("query_id", "doc_id", "rank")
    x = pool.join(d.withColumnRenamed("tokens", "dt"), "doc_id").join(q, "query_id").select("query_id", "doc_id", "rank", F.round(T.jaccard(F.col("tokens"), F.col("dt")), 6).alias("score"))
    return x.withColumn("reranked", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
