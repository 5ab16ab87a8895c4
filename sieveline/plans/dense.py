"""Vector queries. The query set is every vector whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import dense as D
from .registry import Tables, query

E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
#: All pairs of the query set with scores of the whole vector and of its halves.
PAIRS = f"""{E}, pairs AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, q.label AS ql, d.label AS dl, round(list_cosine_similarity(q.v, d.v), 6) AS s, round(list_cosine_similarity(q.v[1:32], d.v[1:32]), 6) AS s1, round(list_cosine_similarity(q.v[33:64], d.v[33:64]), 6) AS s2 FROM e q JOIN e d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id)"""


def run_sql(name: str, score: str, k: int) -> str:
    return f"{name} AS (SELECT query_id, doc_id, {score} AS score, ql, dl, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, doc_id) AS rank FROM pairs QUALIFY rank <= {k})"


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))


def asked(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))


HALVES = (None, (0, 32), (32, 64))


def run(t: Tables, k: int, half: int = 0, **more) -> DataFrame:
    """The dense run over whole vectors (0) or a half (1, 2)."""
    return D.search(asked(t), vectors(t), k, dims=HALVES[half], **more)


def rescored(t: Tables, pool: DataFrame, half: int) -> DataFrame:
    """A pool's scores over a half."""
    return D.rescore(pool, asked(t), vectors(t), HALVES[half])


@query(f"WITH {PAIRS}, {run_sql('r', 's', 10)} SELECT query_id, doc_id, score, rank FROM r")
def j9_dense_topk(t: Tables) -> DataFrame:
    return run(t, 10)


@query(f"WITH {PAIRS}, {run_sql('r', 's', 10)} SELECT query_id, doc_id, score, rank, round(2 * (1 - score), 6) AS l2, round(1 - (2 * (1 - score)) / 2, 6) AS cosine FROM r")
def r7_l2_metric_switch(t: Tables) -> DataFrame:
    l2 = 2 * (1 - F.col("score"))
    return run(t, 10).select("query_id", "doc_id", "score", "rank", F.round(l2, 6).alias("l2"), F.round(1 - l2 / 2, 6).alias("cosine"))


@query(f"WITH {E}, x AS (SELECT label, vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM e), m AS (SELECT label, dim, avg(x) AS c FROM x GROUP BY label, dim) SELECT label, CAST(dim AS INTEGER) AS dim, round(c / sqrt(sum(c * c) OVER (PARTITION BY label)), 6) AS x FROM m")
def a5_centroid(t: Tables) -> DataFrame:
    s = V.sums(t.embeddings.select("label", F.col("embedding").alias("v")), ["label"])
    return s.select("label", F.posexplode(V.unit(F.col("total"))).alias("dim", "x")).select("label", "dim", F.round("x", 6).alias("x"))


@query(f"WITH {E}, x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM e), m AS (SELECT label, dim, avg(x) AS c FROM x GROUP BY label, dim), n AS (SELECT label, list(c ORDER BY dim) AS c FROM m GROUP BY label) SELECT label, count(*) AS n, round(avg(list_cosine_similarity(n.c, e.v)), 6) AS specificity FROM e JOIN n USING (label) GROUP BY label")
def a6_specificity(t: Tables) -> DataFrame:
    s = V.sums(t.embeddings.select("label", F.col("embedding").alias("v")), ["label"])
    return s.select("label", "n", F.round(V.specificity(F.col("total"), F.col("n")), 6).alias("specificity"))


@query(f"WITH {E} SELECT a.label, count(*) AS n_pairs, round(avg(list_dot_product(a.v, b.v)), 6) AS coherence FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label")
def a8_coherence(t: Tables) -> DataFrame:
    s = V.sums(t.embeddings.select("label", F.col("embedding").alias("v")), ["label"])
    return s.select("label", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n_pairs"), F.round(V.coherence(F.col("total"), F.col("n")), 6).alias("coherence"))


@query()
def j10_near_classes(t: Tables) -> DataFrame:
    """All pairs of vectors with a cosine of at least 0.97, as the class of each vector and its number of links."""
    return D.near(vectors(t), 0.97).withColumnRenamed("doc_id", "vec_id")


@query()
def b18_query_aliases(t: Tables) -> DataFrame:
    """Each vector's canonical one: of equal vectors the first, then of near ones (cosine of at least 0.97, in chains) the one of the least label, then id."""
    x = t.embeddings.select(F.col("vec_id").alias("doc_id"), "label", F.col("embedding").cast("array<double>").alias("v")).withColumn("key", F.md5(F.array_join(F.transform("v", lambda y: y.cast("string")), ",").cast("binary")))
    first = x.groupBy("key").agg(F.min_by("doc_id", F.struct("label", "doc_id")).alias("first"))
    heads = x.join(first, "key").where("doc_id = first")
    near = D.near(heads.select("doc_id", "v"), 0.97).join(heads.select("doc_id", "label", "key"), "doc_id")
    best = near.groupBy("root").agg(F.min_by("doc_id", F.struct("label", "doc_id")).alias("canonical"))
    return x.select("doc_id", "key").join(near.select("key", "root"), "key").join(best, "root").select(F.col("doc_id").alias("vec_id"), "canonical")


def _members(t: Tables, found: DataFrame) -> DataFrame:
    return found.join(vectors(t), "doc_id")


def _shown(moved: DataFrame, t: Tables, k: int = 10) -> DataFrame:
    return D.search(moved, vectors(t), k, digits=5)


def _moved_sql(expr: str, k: int, centre: str) -> str:
    return f"""WITH {PAIRS}, {run_sql('r', 's', k)}, x AS (SELECT query_id, generate_subscripts(e.v, 1) AS dim, unnest(e.v) AS x FROM r JOIN e ON e.vec_id = r.doc_id), m AS (SELECT query_id, dim, avg(x) AS c FROM x GROUP BY query_id, dim), n AS (SELECT query_id, list(c ORDER BY dim) AS raw FROM m GROUP BY query_id), u AS (SELECT query_id, {centre} AS c, e.v AS q FROM n JOIN e ON e.vec_id = query_id), w AS (SELECT query_id, {expr} AS v FROM u)
SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(w.v, e.v), 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(w.v, e.v), 5) DESC, vec_id) AS rank FROM w, e WHERE query_id <> vec_id QUALIFY rank <= 10"""


UNIT = "list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw)))"


@query(_moved_sql("list_transform(range(1, 65), lambda i: 0.7 * q[i] + 0.3 * c[i])", 5, UNIT))
def r15_prf(t: Tables) -> DataFrame:
    s = V.sums(_members(t, run(t, 5)), ["query_id"])
    moved = s.join(asked(t), "query_id").select("query_id", V.blend(V.unit(F.col("v")), V.unit(F.col("total")), 0.7).alias("v"))
    return _shown(moved, t)


@query(_moved_sql("list_transform(range(1, 65), lambda i: 0.8 * q[i] + 0.2 * (c[i] - list_dot_product(c, q) * q[i]) / sqrt(1 - list_dot_product(c, q) ** 2))", 5, UNIT))
def r16_rocchio_qperp(t: Tables) -> DataFrame:
    s = V.sums(_members(t, run(t, 5)), ["query_id"]).join(asked(t), "query_id").select("query_id", V.unit(F.col("v")).alias("q"), V.unit(F.col("total")).alias("c"))
    along = V.dot(F.col("c"), F.col("q"))
    rest = s.select("query_id", "q", V.unit(F.zip_with("c", V.scaled(F.col("q"), along), lambda a, b: a - b)).alias("p"))
    return _shown(rest.select("query_id", V.blend(F.col("q"), F.col("p"), 0.8).alias("v")), t)


@query(f"""WITH {PAIRS}, {run_sql('r1', 's1', 20)}, {run_sql('r2', 's2', 20)}, b AS (SELECT r1.query_id, r1.doc_id FROM r1 JOIN r2 USING (query_id, doc_id)), x AS (SELECT query_id, generate_subscripts(e.v, 1) AS dim, unnest(e.v) AS x FROM b JOIN e ON e.vec_id = b.doc_id), m AS (SELECT query_id, dim, avg(x) AS c FROM x GROUP BY query_id, dim), n AS (SELECT query_id, list(c ORDER BY dim) AS c FROM m GROUP BY query_id),
w AS (SELECT e.vec_id AS query_id, CASE WHEN c IS NULL THEN e.v ELSE list_transform(range(1, 65), lambda i: 0.5 * e.v[i] + 0.5 * c[i]) END AS v FROM e LEFT JOIN n ON n.query_id = e.vec_id WHERE e.vec_id % 20 = 0)
SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(w.v, e.v), 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(w.v, e.v), 5) DESC, vec_id) AS rank FROM w, e WHERE query_id <> vec_id QUALIFY rank <= 10""")
def r17_intersection_prf(t: Tables) -> DataFrame:
    both = run(t, 20, 1).select("query_id", "doc_id").join(run(t, 20, 2).select("query_id", "doc_id"), ["query_id", "doc_id"])
    s = V.sums(_members(t, both), ["query_id"])
    mean = F.transform("total", lambda x: x / F.col("n"))
    moved = asked(t).join(s, "query_id", "left").select("query_id", F.when(F.col("n").isNull(), F.col("v").cast("array<double>")).otherwise(V.blend(F.col("v"), mean, 0.5)).alias("v"))
    return _shown(moved, t)


@query(f"""WITH {E}, x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM e), m AS (SELECT label, dim, sum(x) AS t, avg(x) AS c FROM x GROUP BY label, dim), n AS (SELECT label, list(c ORDER BY dim) AS c, sqrt(sum(c * c)) AS spec FROM m GROUP BY label),
p AS (SELECT e.vec_id AS query_id, n.label, round(list_cosine_similarity(e.v, n.c), 6) AS sim, spec FROM e, n WHERE e.vec_id % 20 = 0), k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, label) <= 5)
SELECT query_id, round(sum(sim * spec) / nullif(sum(sim), 0), 3) AS predicted FROM k GROUP BY query_id""")
def r21_specificity_knn(t: Tables) -> DataFrame:
    s = V.sums(t.embeddings.select("label", F.col("embedding").alias("v")), ["label"])
    centres = s.select(F.col("label").cast("long").alias("doc_id"), F.col("total").alias("v"))
    near = D.search(asked(t), centres, 5, same=True)
    x = near.join(s.select(F.col("label").cast("long").alias("doc_id"), V.specificity(F.col("total"), F.col("n")).alias("spec")), "doc_id")
    return x.groupBy("query_id").agg(F.round(F.sum(F.col("score") * F.col("spec")) / F.nullif(F.sum("score"), F.lit(0.0)), 3).alias("predicted"))


@query(f"""WITH {E}, q AS (SELECT vec_id AS query_id, unnest([0, 1, 2, 3]) AS i, unnest([v[1:16], v[17:32], v[33:48], v[49:64]]) AS x FROM e WHERE vec_id % 20 = 0), d AS (SELECT vec_id AS doc_id, unnest([v[1:16], v[17:32], v[33:48], v[49:64]]) AS x FROM e),
s AS (SELECT query_id, doc_id, i, max(list_dot_product(q.x, d.x)) AS best FROM q, d WHERE query_id <> doc_id GROUP BY query_id, doc_id, i), z AS (SELECT query_id, doc_id, round(sum(best), 6) AS score FROM s GROUP BY query_id, doc_id)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM z QUALIFY rank <= 10""")
def r23_maxsim(t: Tables) -> DataFrame:
    """Late interaction: each quarter of a vector stands for a token."""
    from ..operators.late import max_sim

    return max_sim(asked(t), vectors(t), parts=4, k=10)


@query(f"WITH {PAIRS}, r AS (SELECT query_id, doc_id, s FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) = 1) SELECT query_id, doc_id, s AS score FROM r")
def b14_nearest_pair(t: Tables) -> DataFrame:
    return run(t, 1).select("query_id", "doc_id", "score")


@query(f"WITH {PAIRS}, {run_sql('a', 's', 10)}, {run_sql('b', 's1', 10)} SELECT a.query_id, count(b.doc_id) / 10.0 AS recall FROM a LEFT JOIN b USING (query_id, doc_id) GROUP BY a.query_id")
def b15_neighbour_recall(t: Tables) -> DataFrame:
    a, b = run(t, 10).select("query_id", "doc_id"), run(t, 10, 1).select("query_id", "doc_id", F.lit(1).alias("hit"))
    return a.join(b, ["query_id", "doc_id"], "left").groupBy("query_id").agg((F.count("hit") / 10.0).alias("recall"))


@query(f"WITH {E} SELECT count(*) AS n, count(*) FILTER (WHERE isnan(list_dot_product(v, v)) OR sqrt(list_dot_product(v, v)) < 0.5) AS bad, round(min(sqrt(list_dot_product(v, v))), 4) AS least, round(max(sqrt(list_dot_product(v, v))), 4) AS most FROM e")
def dq2_vector_sanity(t: Tables) -> DataFrame:
    n = t.embeddings.select(V.norm(F.col("embedding")).alias("n"))
    return n.agg(F.count("*").alias("n"), F.count_if(F.isnan("n") | (F.col("n") < 0.5)).alias("bad"), F.round(F.min("n"), 4).alias("least"), F.round(F.max("n"), 4).alias("most"))


@query(f"WITH {E}, p AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(q.v, d.v), 6) AS s FROM e q JOIN e d ON q.vec_id % 20 = 0), r AS (SELECT query_id, doc_id FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) = 1) SELECT count(*) AS n, count(*) FILTER (WHERE query_id = doc_id) AS own FROM r")
def dq3_self_retrieval(t: Tables) -> DataFrame:
    return run(t, 1, same=True).agg(F.count("*").alias("n"), F.count_if(F.col("query_id") == F.col("doc_id")).alias("own"))


@query(f"WITH {E}, m AS (SELECT generate_subscripts(v, 1) AS dim, unnest(v) AS x FROM e WHERE vec_id % 20 = 0), c AS (SELECT list(a ORDER BY dim) AS v FROM (SELECT dim, avg(x) AS a FROM m GROUP BY dim)) SELECT vec_id, round(list_dot_product(e.v, c.v), 5) AS projection FROM e, c")
def o2_locality_sort(t: Tables) -> DataFrame:
    mean = V.sums(asked(t).withColumn("g", F.lit(0)), ["g"]).select(F.transform("total", lambda x: x / F.col("n")).alias("c"))
    x = t.embeddings.crossJoin(F.broadcast(mean))
    return x.select("vec_id", F.round(V.dot(F.col("embedding"), F.col("c")), 5).alias("projection")).orderBy("projection", "vec_id")
