"""Propagation, routing and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import dense as D
from ..operators import propagate as L
from ..operators import stats as S
from .dense import PAIRS, asked, run, run_sql, vectors
from .metrics import QRELS, RECALL, RUNS, graded, recalls
from .registry import Tables, query

LABELLED = f"WITH {PAIRS}, {run_sql('a', 's', 10)}, r AS (SELECT query_id, doc_id, score, rank, dl AS label FROM a)"
TOP2 = "p AS (SELECT query_id, label, max(score) AS top FROM r GROUP BY ALL), z AS (SELECT query_id, label, top, round(top - coalesce(lead(top) OVER (PARTITION BY query_id ORDER BY top DESC, label), 0), 6) AS margin, row_number() OVER (PARTITION BY query_id ORDER BY top DESC, label) AS k FROM p)"


def neighbours(t: Tables, k: int = 10) -> DataFrame:
    """The dense run with the documents' labels."""
    return run(t, k).join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")


@query(f"{LABELLED}, {TOP2} SELECT query_id, label, top, margin FROM z WHERE k = 1")
def l1_nn_per_class(t: Tables) -> DataFrame:
    return L.best_two(neighbours(t), "query_id", "label", "score")


@query(f"{LABELLED}, {TOP2} SELECT query_id, label, top, margin FROM z WHERE k = 1 AND margin >= 0.02")
def a22_margin(t: Tables) -> DataFrame:
    return L.best_two(neighbours(t), "query_id", "label", "score").where("margin >= 0.02")


VOTES = "v AS (SELECT query_id, label, count(*) AS votes, min(rank) AS first FROM r GROUP BY ALL), w AS (SELECT query_id, label, votes, round(votes / sum(votes) OVER (PARTITION BY query_id), 6) AS share, first = 1 AS nearest, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS k FROM v)"


@query(f"{LABELLED}, {VOTES} SELECT query_id, label, votes, share, nearest FROM w WHERE k = 1")
def a23_majority_vote(t: Tables) -> DataFrame:
    return L.vote(neighbours(t), "query_id", "label")


@query(f"{LABELLED}, {VOTES}, {TOP2} SELECT query_id, w.label, share, nearest, margin FROM w JOIN z USING (query_id) WHERE w.k = 1 AND z.k = 1 AND w.label = z.label AND share >= 0.2")
def l5_knn_vote(t: Tables) -> DataFrame:
    """Majority labels that the best class agrees with, above a share."""
    n = neighbours(t)
    both = L.vote(n, "query_id", "label").join(L.best_two(n, "query_id", "label", "score"), ["query_id", "label"])
    return both.where("share >= 0.2").select("query_id", "label", "share", "nearest", "margin")


@query(f"{LABELLED}, {TOP2} SELECT e.vec_id, CASE WHEN e.vec_id % 60 = 0 THEN 'seed' WHEN margin >= .08 THEN 'confident' WHEN margin >= .02 AND top >= .25 THEN 'likely' ELSE 'unclassified' END AS source, CASE WHEN e.vec_id % 60 = 0 THEN e.label WHEN margin >= .08 OR margin >= .02 AND top >= .25 THEN z.label END AS label FROM e LEFT JOIN (SELECT * FROM z WHERE k = 1) z ON z.query_id = e.vec_id WHERE e.vec_id % 20 = 0")
def l3_compose(t: Tables) -> DataFrame:
    """Seeds, then confident, then likely labels; the rest stays unclassified."""
    z = L.best_two(neighbours(t), "query_id", "label", "score").withColumnRenamed("label", "found")
    x = t.embeddings.where("vec_id % 20 = 0").join(z, F.col("vec_id") == F.col("query_id"), "left")
    seed, sure, likely = F.col("vec_id") % 60 == 0, F.col("margin") >= 0.08, (F.col("margin") >= 0.02) & (F.col("top") >= 0.25)
    source = F.when(seed, "seed").when(sure, "confident").when(likely, "likely").otherwise("unclassified")
    return x.select("vec_id", source.alias("source"), F.when(seed, F.col("label")).when(sure | likely, F.col("found")).alias("label"))


@query(f"{LABELLED}, {TOP2}, c AS (SELECT query_id AS vec_id, label FROM z WHERE k = 1 AND margin >= .02 AND top >= .25), s AS (SELECT * FROM c), n AS (SELECT p.query_id, s.label, p.s FROM pairs p JOIN s ON s.vec_id = p.doc_id WHERE p.query_id NOT IN (SELECT vec_id FROM c) QUALIFY row_number() OVER (PARTITION BY p.query_id ORDER BY p.s DESC, p.doc_id) = 1) SELECT vec_id, label, 1 AS round FROM c UNION ALL SELECT query_id, label, 2 FROM n WHERE s >= 0.05")
def l4_second_round(t: Tables) -> DataFrame:
    """Confident labels become seeds for what is left."""
    c = L.best_two(neighbours(t), "query_id", "label", "score").where("margin >= 0.02 AND top >= 0.25").select(F.col("query_id").alias("vec_id"), "label")
    v = vectors(t)
    seeds = v.join(c.withColumnRenamed("vec_id", "doc_id"), "doc_id")
    rest = asked(t).join(c.withColumnRenamed("vec_id", "query_id"), "query_id", "left_anti")
    near = D.search(rest, seeds, 1).where("score >= 0.05").join(c.withColumnRenamed("vec_id", "doc_id"), "doc_id")
    return c.withColumn("round", F.lit(1)).unionByName(near.select(F.col("query_id").alias("vec_id"), "label", F.lit(2).alias("round")))



@query()
def l2_tfidf_catalogue(t: Tables) -> DataFrame:
    """Nearest of all texts, for those whose number is divisible by 20: one and two words, in two documents at least and in half of them at most."""
    from ..operators import texts

    return texts.nearest(t.documents.select("doc_id", "text"), 5, least=2, most=0.5)



@query(f"{LABELLED}, {VOTES} SELECT e.vec_id AS query_id, e.label AS own, coalesce(CAST(w.label AS VARCHAR), 'unclassified') AS label FROM e LEFT JOIN (SELECT * FROM w WHERE k = 1 AND share >= 0.3) w ON w.query_id = e.vec_id WHERE e.vec_id % 20 = 0")
def l8_explode_labels(t: Tables) -> DataFrame:
    v = L.vote(neighbours(t), "query_id", "label").where("share >= 0.3").select("query_id", F.col("label").cast("string").alias("found"))
    x = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")).join(v, "query_id", "left")
    return x.select("query_id", "own", F.coalesce("found", F.lit("unclassified")).alias("label"))


@query(f"{LABELLED}, {VOTES}, c AS (SELECT e.label AS truth, w.label AS found FROM w JOIN e ON e.vec_id = w.query_id WHERE k = 1), k AS (SELECT label, (SELECT count(*) FROM c WHERE truth = k0.label AND found = k0.label) AS tp, (SELECT count(*) FROM c WHERE found = k0.label) AS found, (SELECT count(*) FROM c WHERE truth = k0.label) AS truth FROM (SELECT DISTINCT label FROM e) k0) SELECT label, tp, found, truth, round(2 * tp / nullif(found + truth, 0), 6) AS f1 FROM k")
def l7_f1_by_label(t: Tables) -> DataFrame:
    v = L.vote(neighbours(t), "query_id", "label").select("query_id", F.col("label").alias("found"))
    c = v.join(t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("label").alias("truth")), "query_id")
    sides = c.select(F.col("found").alias("label"), F.lit(1).alias("f"), F.lit(0).alias("t"), (F.col("found") == F.col("truth")).cast("int").alias("tp")).unionByName(c.select(F.col("truth").alias("label"), F.lit(0).alias("f"), F.lit(1).alias("t"), F.lit(0).alias("tp")))
    n = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("f").alias("found"), F.sum("t").alias("truth"))
    x = t.embeddings.select("label").distinct().join(n, "label", "left").fillna(0)
    return x.select("label", "tp", "found", "truth", F.round(2 * F.col("tp") / F.nullif(F.col("found") + F.col("truth"), F.lit(0)), 6).alias("f1"))


@query("WITH n AS (SELECT source, count(*) AS n, arg_max(doc_id, length(text) * 1000000 - doc_id) AS sample FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source) SELECT source, n, sample FROM n ORDER BY n DESC, source LIMIT 10")
def l9_work_queue(t: Tables) -> DataFrame:
    """Groups that wait for a label, largest first (the limit is the feature)."""
    x = t.documents.join(t.labels, "doc_id", "left_anti")
    return x.groupBy("source").agg(F.count("*").alias("n"), F.max_by("doc_id", F.struct(F.length("text"), -F.col("doc_id"))).alias("sample")).orderBy(F.desc("n"), "source").limit(10)


#: Per query the first run's best score and the recalls.
ROUTED = f"{RUNS}, {RECALL}, o AS (SELECT query_id, max(CASE WHEN rank = 1 THEN score END) AS top, ra, rb FROM a JOIN h USING (query_id) GROUP BY query_id, ra, rb)"


def routed(t: Tables) -> DataFrame:
    top = run(t, 1).select("query_id", F.col("score").alias("top"))
    return recalls(t).join(top, "query_id").select("query_id", "top", "ra", "rb")


@query(f"{ROUTED}, g AS (SELECT unnest([0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6]) AS tau) SELECT CAST(tau AS DOUBLE) AS tau, round(avg(CASE WHEN top >= tau THEN ra ELSE rb END), 6) AS recall, count(*) FILTER (WHERE top >= tau) AS n_base FROM o, g GROUP BY tau")
def g1_threshold_router(t: Tables) -> DataFrame:
    tau = F.explode(F.array(*(F.lit(x) for x in (0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6)))).alias("tau")
    x = routed(t).select("*", tau)
    base = F.col("top") >= F.col("tau")
    return x.groupBy("tau").agg(F.round(F.avg(F.when(base, F.col("ra")).otherwise(F.col("rb"))), 6).alias("recall"), F.count_if(base).alias("n_base"))


@query("WITH q AS (SELECT item_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n, regexp_matches(text, '[0-9]') AS digit FROM benchmark) SELECT rule, count(*) FILTER (WHERE picked) AS n_base FROM (SELECT 'few' AS rule, n <= 12 AS picked FROM q UNION ALL SELECT 'some', n <= 20 FROM q UNION ALL SELECT 'no_digit', NOT digit FROM q) GROUP BY rule")
def g2_heuristic_rules(t: Tables) -> DataFrame:
    from ..functions import text as T

    q = t.benchmark.select(F.size(T.tokens(F.col("text"))).alias("n"), F.col("text").rlike("[0-9]").alias("digit"))
    rules = F.array(*(F.struct(F.lit(n).alias("rule"), c.alias("picked")) for n, c in (("few", F.col("n") <= 12), ("some", F.col("n") <= 20), ("no_digit", ~F.col("digit")))))
    return q.select(F.inline(rules)).groupBy("rule").agg(F.count_if("picked").alias("n_base"))


@query(f"{ROUTED}, t AS (SELECT DISTINCT round(unnest(quantile_cont(top, [x / 20.0 for x in range(0, 21)])), 6) AS tau FROM o), r AS (SELECT tau, round(avg(CASE WHEN top >= tau THEN ra ELSE rb END), 6) AS recall FROM o, t GROUP BY tau) SELECT tau, recall FROM r QUALIFY row_number() OVER (ORDER BY recall DESC, tau) = 1")
def g3_quantile_router(t: Tables) -> DataFrame:
    o = routed(t)
    tau = o.agg(F.percentile("top", [i / 20 for i in range(21)]).alias("q")).select(F.explode("q").alias("tau")).select(F.round("tau", 6).alias("tau")).distinct()
    r = o.join(F.broadcast(tau)).groupBy("tau").agg(F.round(F.avg(F.when(F.col("top") >= F.col("tau"), F.col("ra")).otherwise(F.col("rb"))), 6).alias("recall"))
    return r.orderBy(F.desc("recall"), "tau").limit(1)


COHERENT = ", ".join(f"k{n} AS (SELECT x.query_id, round(avg(list_dot_product(p.v, q.v)), 5) AS c FROM {n} x JOIN {n} y ON x.query_id = y.query_id AND x.doc_id < y.doc_id AND x.rank <= 10 AND y.rank <= 10 JOIN e p ON p.vec_id = x.doc_id JOIN e q ON q.vec_id = y.doc_id GROUP BY x.query_id)" for n in "abc")


def coherent(t: Tables, half: int, name: str) -> DataFrame:
    """The coherence of each query's ten best."""
    s = V.sums(run(t, 10, half).join(vectors(t), "doc_id").select("query_id", "v"), ["query_id"])
    return s.select("query_id", F.round(V.coherence(F.col("total"), F.col("n")), 5).alias(name))


@query(f"{RUNS}, {COHERENT} SELECT ka.query_id, ka.c AS ca, kb.c AS cb, kc.c AS cc, CASE WHEN ka.c >= kb.c AND ka.c >= kc.c THEN 'a' WHEN kb.c >= kc.c THEN 'b' ELSE 'c' END AS pick FROM ka JOIN kb USING (query_id) JOIN kc USING (query_id)")
def g4_coherence_router(t: Tables) -> DataFrame:
    x = coherent(t, 0, "ca").join(coherent(t, 1, "cb"), "query_id").join(coherent(t, 2, "cc"), "query_id")
    a, b, c = F.col("ca"), F.col("cb"), F.col("cc")
    return x.withColumn("pick", F.when((a >= b) & (a >= c), "a").when(b >= c, "b").otherwise("c"))


@query(f"{ROUTED}, {COHERENT}, x AS (SELECT o.query_id, ra, rb, kb.c < 0.08 AS back FROM o JOIN kb USING (query_id)) SELECT count(*) FILTER (WHERE back) AS switched, count(*) FILTER (WHERE back AND ra > rb) AS gained, round(avg(CASE WHEN back THEN ra ELSE rb END), 6) AS recall, round(count(*) FILTER (WHERE back AND ra > rb) / nullif(count(*) FILTER (WHERE ra > rb), 0), 6) AS caught FROM x")
def g6_fallback(t: Tables) -> DataFrame:
    """The base run where the other one's results do not hold together."""
    x = routed(t).join(coherent(t, 1, "cb"), "query_id")
    back, better = F.col("cb") < 0.08, F.col("ra") > F.col("rb")
    return x.agg(F.count_if(back).alias("switched"), F.count_if(back & better).alias("gained"), F.round(F.avg(F.when(back, F.col("ra")).otherwise(F.col("rb"))), 6).alias("recall"), F.round(F.count_if(back & better) / F.nullif(F.count_if(better), F.lit(0)), 6).alias("caught"))


@query(f"{ROUTED} SELECT query_id, round((top - avg(top) OVER ()) / nullif(stddev_pop(top) OVER (), 0), 4) AS z_top, round(ra - rb, 6) AS diff FROM o")
def g7_feature_z(t: Tables) -> DataFrame:
    o = routed(t)
    m = o.agg(F.avg("top").alias("m"), F.stddev_pop("top").alias("sd"))
    return o.crossJoin(F.broadcast(m)).select("query_id", F.round((F.col("top") - F.col("m")) / F.nullif(F.col("sd"), F.lit(0.0)), 4).alias("z_top"), F.round(F.col("ra") - F.col("rb"), 6).alias("diff"))


@query("SELECT event_type, CASE WHEN count(*) >= 3 AND stddev_pop(value) > 0 THEN round(corr(value, user_id), 5) END AS r, count(*) AS n FROM events GROUP BY event_type")
def s1_pearson(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(S.pearson(F.col("value"), F.col("user_id").cast("double")), 5).alias("r"), F.count("*").alias("n"))


@query("WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS b FROM events) SELECT event_type, round(corr(a, b), 5) AS rho FROM r GROUP BY event_type")
def s2_spearman(t: Tables) -> DataFrame:
    x = S.average_rank(S.average_rank(t.events, "value", ["event_type"], "a"), "user_id", ["event_type"], "b")
    return x.groupBy("event_type").agg(F.round(F.corr("a", "b"), 5).alias("rho"))


@query(f"WITH {PAIRS}, {QRELS} SELECT x.query_id, round(avg(CASE WHEN x.s > y.s THEN 1.0 WHEN x.s = y.s THEN .5 ELSE 0 END), 6) AS auc, (SELECT count(*) FROM j z WHERE z.query_id = x.query_id) AS n FROM j x JOIN j y ON x.query_id = y.query_id AND x.grade >= 2 AND y.grade < 2 GROUP BY x.query_id")
def s6_auc(t: Tables) -> DataFrame:
    return S.auc(graded(t), "score", F.col("grade") >= 2, ["query_id"])


@query("WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), c AS (SELECT n, count(*) AS k FROM n GROUP BY n), d AS (SELECT n, sum(k) OVER (ORDER BY n) / sum(k) OVER () AS f FROM c), t AS (SELECT (SELECT n FROM d ORDER BY abs(f - 1 / 3.0), n LIMIT 1) AS lo, (SELECT n FROM d ORDER BY abs(f - 2 / 3.0), n LIMIT 1) AS hi) SELECT CASE WHEN n <= lo THEN 'low' WHEN n <= hi THEN 'mid' ELSE 'high' END AS stratum, count(*) AS size, min(n) AS least, max(n) AS most FROM n, t GROUP BY stratum")
def s8_terciles(t: Tables) -> DataFrame:
    """Strata cut where the cumulative share is nearest to one and two thirds."""
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = n.groupBy("n").agg(F.count("*").alias("k"))
    d = c.select("n", (F.sum("k").over(Window.orderBy("n")) / F.sum("k").over(Window.partitionBy(F.lit(0)))).alias("f"))
    cut = d.agg(F.min_by("n", F.struct(F.abs(F.col("f") - 1 / 3), "n")).alias("lo"), F.min_by("n", F.struct(F.abs(F.col("f") - 2 / 3), "n")).alias("hi"))
    x = n.crossJoin(F.broadcast(cut))
    s = F.when(F.col("n") <= F.col("lo"), "low").when(F.col("n") <= F.col("hi"), "mid").otherwise("high")
    return x.groupBy(s.alias("stratum")).agg(F.count("*").alias("size"), F.min("n").alias("least"), F.max("n").alias("most"))


GRID = "g AS (SELECT unnest([x / 20.0 for x in range(0, 21)]) AS tau)"


def swept(o: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tau, recall, base): the mean recall if queries whose top score is at least tau take the first run, else the second; base is the second's."""
    x = o.select("*", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i")).withColumn("tau", F.col("i") / 20)
    return x.groupBy(*keys, "tau").agg(F.avg(F.when(F.col("top") >= F.col("tau"), F.col("ra")).otherwise(F.col("rb"))).alias("recall"), F.avg("rb").alias("base"))


def chosen(sweep: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tau): the least threshold of the best recall (to 9 digits), or null if none is better than the base."""
    better = sweep.where(F.round(F.col("recall") - F.col("base"), 9) > 0)
    best = better.groupBy(*keys).agg(F.min_by("tau", F.struct(-F.round("recall", 9), F.col("tau"))).alias("tau"))
    return sweep.select(*keys).distinct().join(best, keys, "left") if keys else best


@query(f"{ROUTED}, {GRID}, r AS (SELECT tau, avg(CASE WHEN top >= tau THEN ra ELSE rb END) AS recall, avg(rb) AS base FROM o, g GROUP BY tau), k AS (SELECT tau FROM r WHERE round(recall - base, 9) > 0 ORDER BY round(recall, 9) DESC, tau LIMIT 1) SELECT CAST(tau AS DOUBLE) AS tau, round(recall, 6) AS recall, coalesce(tau = (SELECT tau FROM k), false) AS best FROM r")
def s9_threshold_sweep(t: Tables) -> DataFrame:
    """All thresholds, and the best within the sample if it beats never routing."""
    sweep = swept(routed(t), [])
    best = chosen(sweep, []).withColumnRenamed("tau", "best")
    return sweep.crossJoin(F.broadcast(best)).select("tau", F.round("recall", 6).alias("recall"), F.coalesce(F.col("tau") == F.col("best"), F.lit(False)).alias("best"))


@query(f"{ROUTED}, {GRID}, f AS (SELECT unnest(range(0, 5)) AS fold), r AS (SELECT fold, tau, avg(CASE WHEN top >= tau THEN ra ELSE rb END) AS recall, avg(rb) AS base FROM o, g, f WHERE query_id // 20 % 5 <> fold GROUP BY ALL), k AS (SELECT fold, tau FROM r WHERE round(recall - base, 9) > 0 QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(recall, 9) DESC, tau) = 1) SELECT f.fold, CAST(tau AS DOUBLE) AS tau, count(*) AS n, round(avg(CASE WHEN tau IS NOT NULL AND top >= tau THEN ra ELSE rb END), 6) AS recall, round(avg(rb), 6) AS base FROM o JOIN f ON query_id // 20 % 5 = fold LEFT JOIN k USING (fold) GROUP BY ALL")
def s9_threshold_by_folds(t: Tables) -> DataFrame:
    """A threshold per fold, chosen on the other folds by strict improvement, and what it gives on the fold."""
    o = routed(t).withColumn("own", F.floor(F.col("query_id") / 20) % 5)
    others = o.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("fold")).where("own <> fold")
    x = o.withColumnRenamed("own", "fold").join(F.broadcast(chosen(swept(others, ["fold"]), ["fold"])), "fold", "left")
    used = F.when(F.col("tau").isNotNull() & (F.col("top") >= F.col("tau")), F.col("ra")).otherwise(F.col("rb"))
    return x.groupBy("fold", "tau").agg(F.count("*").alias("n"), F.round(F.avg(used), 6).alias("recall"), F.round(F.avg("rb"), 6).alias("base"))


@query(f"{ROUTED}, p AS (SELECT query_id, top AS x, rb - ra AS y FROM o), l AS (SELECT a.query_id, any_value(a.y) AS y, any_value(a.x) * regr_slope(b.y, b.x) + regr_intercept(b.y, b.x) AS y_hat FROM p a JOIN p b ON a.query_id <> b.query_id GROUP BY a.query_id), w AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, var_pop(y) * count(*) AS ss FROM p) SELECT any_value(round(slope, 4)) AS slope, any_value(round(intercept, 4)) AS intercept, any_value(round(r2, 4)) AS r2, round(sqrt(avg((y - y_hat) ** 2)), 4) AS loo_rmse, round(1 - sum((y - y_hat) ** 2) / any_value(ss), 4) AS loo_r2 FROM l, w")
def s10_regression(t: Tables) -> DataFrame:
    """What the second run gains, on the first run's best score; each query also predicted from all others."""
    p = routed(t).select(F.col("top").alias("x"), (F.col("rb") - F.col("ra")).alias("y"))
    return S.leave_one_out(p).select(*(F.round(c, 4).alias(c) for c in ("slope", "intercept", "r2", "loo_rmse", "loo_r2")))


@query(f"{RUNS}, {RECALL}, w AS (SELECT count(*) FILTER (WHERE rb > ra) AS w, count(*) FILTER (WHERE rb <> ra) AS n FROM h) SELECT w AS wins, n, round((SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) FROM (SELECT unnest(range(greatest(w, n - w), n + 1)) AS k)), 6) AS p_one_sided FROM w")
def s7_sign_test(t: Tables) -> DataFrame:
    """The exact binomial tail of as many wins, by a running sum of log factorials."""
    a, b = F.col("ra"), F.col("rb")
    w = recalls(t).agg(F.count_if(b > a).alias("wins"), F.count_if(b != a).alias("n"))
    log_factorial = lambda m: F.aggregate(F.sequence(F.lit(1), F.greatest(m.cast("int"), F.lit(1))), F.lit(0.0), lambda s, x: s + F.log(x))
    n, k0 = F.col("n"), F.greatest(F.col("wins"), F.col("n") - F.col("wins"))
    tail = F.aggregate(F.sequence(k0.cast("int"), n.cast("int")), F.lit(0.0), lambda s, k: s + F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * F.log(F.lit(2.0))))
    return w.select("wins", "n", F.round(tail, 6).alias("p_one_sided"))


def deltas(t: Tables) -> DataFrame:
    return recalls(t).select(F.col("query_id").alias("id"), (F.col("rb") - F.col("ra")).alias("delta"))


@query()
def s3_paired_bootstrap(t: Tables) -> DataFrame:
    d = deltas(t)
    return S.interval(S.bootstrap(d, "delta", 1000, 7)).crossJoin(F.broadcast(d.agg(F.avg("delta").alias("point"))))


@query()
def s4_did_bootstrap(t: Tables) -> DataFrame:
    """The difference of two strata's mean differences."""
    d = deltas(t)
    one, two = (S.bootstrap(d.where(c), "delta", 1000, 11).withColumnRenamed("mean", n) for c, n in (("id % 40 = 0", "a"), ("id % 40 <> 0", "b")))
    return S.interval(one.join(two, "draw").select("draw", (F.col("a") - F.col("b")).alias("mean")))


@query()
def s5_permutation(t: Tables) -> DataFrame:
    """The share of sign flips whose mean is at least as large."""
    d = deltas(t)
    each = d.select("id", "delta", F.explode(F.sequence(F.lit(0), F.lit(999))).alias("draw")).withColumn("x", F.when(F.pmod(F.hash(F.lit(5), "id", "draw"), F.lit(2)) == 0, F.col("delta")).otherwise(-F.col("delta")))
    m = each.groupBy("draw").agg(F.avg("x").alias("mean")).crossJoin(F.broadcast(d.agg(F.avg("delta").alias("seen"))))
    return m.agg(F.avg(F.when(F.abs("mean") >= F.abs("seen"), 1.0).otherwise(0.0)).alias("p"))


@query()
def b13_weighted_sample(t: Tables) -> DataFrame:
    """Bags drawn with chances by their coherence: the smallest of -ln(u) / weight (the sample is the feature)."""
    c = coherent(t, 0, "w")
    u = (F.abs(F.hash(F.lit(3), F.col("query_id"))) + 1) / 2147483649.0
    return c.withColumn("key", -F.log(u) / F.greatest("w", F.lit(1e-6))).orderBy("key").limit(10)


@query()
def l6_logistic_labels(t: Tables) -> DataFrame:
    """A multinomial model over the vectors, its label and its probability per vector."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = t.embeddings.select("vec_id", F.col("label").cast("double"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = LogisticRegression(maxIter=20, regParam=0.1).fit(x.where("vec_id % 5 <> 0"))
    return model.transform(x).select("vec_id", F.col("label").cast("int"), F.col("prediction").cast("int").alias("found"), F.array_max(vector_to_array("probability")).alias("p"))


@query()
def g5_learned_router(t: Tables) -> DataFrame:
    """A logistic model of whether the other run is better, from the first run's scores."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    o = routed(t).join(coherent(t, 0, "ca"), "query_id").withColumn("label", (F.col("rb") > F.col("ra")).cast("double"))
    x = VectorAssembler(inputCols=["top", "ca"], outputCol="features").transform(o)
    model = LogisticRegression(maxIter=20, regParam=0.1).fit(x)
    return model.transform(x).select("query_id", "label", "prediction")


