"""Further queries: rewriting, cached vectors, class boosts, regimes, violations, normalised scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import dense as D
from ..operators import fusion as U
from ..operators import lexical as L
from ..operators import metrics as M
from ..operators import stats as S
from .dense import E, PAIRS, asked, run, run_sql, vectors
from .etl import first_by
from .lexical import RANKED, TYPOS, bm25_sql, content, typos
from .metrics import QRELS, RUNS, graded, qrels
from .registry import Tables, query


@query(f"WITH {PAIRS}, {run_sql('r', 's', 5)} SELECT query_id, doc_id, score, rank FROM r")
def r22_nearest_lookup(t: Tables) -> DataFrame:
    return run(t, 5)


@query()
def r6_ann(t: Tables) -> DataFrame:
    """Approximate search by inverted lists; its recall against `j9_dense_topk` is measured in a test."""
    return D.approximate(asked(t), vectors(t), 10).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {TYPOS}, x AS (SELECT word, term FROM a JOIN v ON levenshtein(word, term) <= 2 WHERE length(word) > 2 AND word NOT IN (SELECT term FROM v) QUALIFY row_number() OVER (PARTITION BY word ORDER BY levenshtein(word, term), cf DESC, term) = 1) SELECT word, CASE WHEN length(word) % 5 = 0 THEN upper(word) ELSE coalesce(term, word) END AS q, CASE WHEN length(word) % 5 = 0 THEN 'rewrite' WHEN term IS NOT NULL THEN 'spell' ELSE 'original' END AS source FROM a LEFT JOIN x USING (word)")
def r12_rewrite_waterfall(t: Tables) -> DataFrame:
    """A given rewrite, else the spelling correction, else the word itself."""
    w, v = typos(t)
    x = w.join(L.correct(w, v), "word", "left")
    given = F.when(F.length("word") % 5 == 0, F.upper("word"))
    source = F.when(given.isNotNull(), "rewrite").when(F.col("correction").isNotNull(), "spell").otherwise("original")
    return x.select("word", F.coalesce(given, "correction", "word").alias("q"), source.alias("source"))


@query(f"WITH {E}, c AS (SELECT vec_id, v FROM e WHERE vec_id % 3 = 0), q AS (SELECT vec_id FROM e WHERE vec_id % 20 = 0) SELECT q.vec_id AS query_id, c.v IS NOT NULL AS cached FROM q LEFT JOIN c USING (vec_id)")
def r24_vector_cache(t: Tables) -> DataFrame:
    cache = t.embeddings.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.lit(True).alias("hit"))
    return asked(t).join(cache, "query_id", "left").select("query_id", F.coalesce("hit", F.lit(False)).alias("cached"))


CLASS = "cx AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM e), cm AS (SELECT label, dim, avg(x) AS c FROM cx GROUP BY ALL), cl AS (SELECT label, list(c ORDER BY dim) AS c FROM cm GROUP BY label)"


@query(f"""WITH {PAIRS}, {run_sql('a', 's', 20)}, {CLASS}, k AS (SELECT vec_id AS query_id, cl.label FROM e, cl WHERE vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(v, c), 6) DESC, cl.label) = 1),
z AS (SELECT a.query_id, a.doc_id, 1 - (a.rank - 1) / 19.0 + CASE WHEN a.dl = k.label THEN 0.3 ELSE 0 END AS score FROM a JOIN k USING (query_id)) SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM z QUALIFY rank <= 10""")
def r25_class_boost(t: Tables) -> DataFrame:
    """Documents of the class whose centroid is nearest to the query move up."""
    c = V.sums(t.embeddings.select("label", F.col("embedding").alias("v")), ["label"]).select(F.col("label").cast("long").alias("doc_id"), F.col("total").alias("v"))
    own = D.search(asked(t), c, 1, same=True).select("query_id", F.col("doc_id").alias("class"))
    x = run(t, 20).join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id").join(own, "query_id")
    score = 1 - (F.col("rank") - 1) / 19.0 + F.when(F.col("label") == F.col("class"), 0.3).otherwise(0.0)
    return U.ranked(x.select("query_id", "doc_id", score.alias("score")), 10)


@query(f"WITH {E}, {CLASS} SELECT label, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS dim, round(unnest(c), 6) AS x FROM cl")
def a7_cluster_means(t: Tables) -> DataFrame:
    s = V.sums(t.embeddings.select("label", F.col("embedding").alias("v")), ["label"])
    return s.select("label", F.posexplode(F.transform("total", lambda x: x / F.col("n"))).alias("dim", "x")).select("label", "dim", F.round("x", 6).alias("x"))


@query(f"WITH {PAIRS}, {QRELS}, m AS (SELECT query_id, doc_id, v FROM j JOIN e ON e.vec_id = doc_id WHERE grade >= 2) SELECT x.query_id, round(min(list_dot_product(x.v, y.v)), 6) AS least, round(max(list_dot_product(x.v, y.v)), 6) AS most, round(avg(list_dot_product(x.v, y.v)), 5) AS mean FROM m x JOIN m y ON x.query_id = y.query_id AND x.doc_id < y.doc_id GROUP BY x.query_id")
def a9_pair_extremes(t: Tables) -> DataFrame:
    from .metrics import judged_sums, mean_product, pair_extremes

    mean = judged_sums(t).select("query_id", F.round(mean_product("p"), 5).alias("mean"))
    return pair_extremes(t).where("pp_min IS NOT NULL").join(mean, "query_id").select("query_id", F.col("pp_min").alias("least"), F.col("pp_max").alias("most"), "mean")


@query("SELECT trim(lower(event_type)) AS q, count(DISTINCT user_id) AS n FROM events GROUP BY 1 HAVING count(DISTINCT user_id) >= 2")
def a4_multi_positive(t: Tables) -> DataFrame:
    return t.events.groupBy(F.trim(F.lower("event_type")).alias("q")).agg(F.countDistinct("user_id").alias("n")).where("n >= 2")


@query(f"{RUNS}, u AS (SELECT query_id, doc_id FROM a WHERE rank <= 10 UNION SELECT query_id, doc_id FROM b WHERE rank <= 10), k AS (SELECT query_id, count(*) AS k FROM u GROUP BY query_id) SELECT query_id, k, count(doc_id) AS same_size FROM (SELECT k.query_id, k, a.doc_id FROM k JOIN a ON a.query_id = k.query_id AND a.rank <= k) GROUP BY query_id, k")
def u5_union_of_tops(t: Tables) -> DataFrame:
    """The union of two runs' tops, against one run of the same size."""
    a, b = run(t, 100), run(t, 100, 1)
    k = a.where("rank <= 10").select(*M.KEY).union(b.where("rank <= 10").select(*M.KEY)).distinct().groupBy("query_id").agg(F.count("*").alias("k"))
    return a.join(k, "query_id").where("rank <= k").groupBy("query_id", "k").agg(F.count("*").alias("same_size"))


@query("SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT o_custkey FROM orders")
def u6_shared_ids(t: Tables) -> DataFrame:
    of = lambda k: t.events.where(F.col("event_type") == k).select("user_id")
    return of("click").intersect(of("purchase")).intersect(t.orders.select("o_custkey"))


@query("SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer")
def w1_row_number(t: Tables) -> DataFrame:
    return t.customer.select("c_nationkey", "c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")).alias("rank"))


@query("SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3")
def w3_stable_topk(t: Tables) -> DataFrame:
    by = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return t.part.withColumn("n", F.row_number().over(by)).where("n <= 3").select("p_brand", "p_partkey")


@query("SELECT s_suppkey, round((s_acctbal - min(s_acctbal) OVER w) / greatest(max(s_acctbal) OVER w - min(s_acctbal) OVER w, 1e-8), 6) AS x FROM supplier WINDOW w AS (PARTITION BY s_nationkey)")
def w6_min_max(t: Tables) -> DataFrame:
    x = t.supplier.withColumnRenamed("s_nationkey", "query_id")
    return x.select("s_suppkey", F.round(U.min_max("s_acctbal"), 6).alias("x"))


@query("SELECT s_suppkey, round(CASE WHEN stddev_pop(s_acctbal) OVER w > 1e-9 THEN (s_acctbal - avg(s_acctbal) OVER w) / stddev_pop(s_acctbal) OVER w ELSE 0 END, 5) AS z FROM supplier WINDOW w AS (PARTITION BY s_nationkey)")
def w7_z_score(t: Tables) -> DataFrame:
    x = t.supplier.withColumnRenamed("s_nationkey", "query_id")
    return x.select("s_suppkey", F.round(U.z_score("s_acctbal"), 5).alias("z"))


@query("SELECT p_brand, p_partkey, round(p_retailprice - coalesce(lead(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey), 0), 4) AS margin FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1")
def w9_runner_up(t: Tables) -> DataFrame:
    by = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    x = t.part.withColumn("next", F.lead("p_retailprice").over(by)).withColumn("n", F.row_number().over(by)).where("n = 1")
    return x.select("p_brand", "p_partkey", F.round(F.col("p_retailprice") - F.coalesce("next", F.lit(0.0)), 4).alias("margin"))


@query(f"WITH {E}, c AS (SELECT list_cosine_similarity(v, list_transform(v, lambda x: floor(x * 16 + 0.5) / 16)) AS c FROM e) SELECT count(*) AS n, count(*) FILTER (WHERE round(c, 6) > .99) AS kept, round(min(c), 5) AS least, count(*) FILTER (WHERE round(c, 6) > .99) = count(*) AS ok FROM c")
def dq4_drift(t: Tables) -> DataFrame:
    """Stored vectors against others of the same ids (here: kept in steps of a sixteenth), by cosine; any loss is drift."""
    stepped = t.embeddings.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 16 + 0.5) / 16).alias("w"))
    c = t.embeddings.join(stepped, "vec_id").select(V.dot(V.unit(F.col("embedding")), V.unit(F.col("w"))).alias("c"))
    kept = F.count_if(F.round("c", 6) > 0.99)
    return c.agg(F.count("*").alias("n"), kept.alias("kept"), F.round(F.min("c"), 5).alias("least"), (kept == F.count("*")).alias("ok"))


@query(f"WITH {PAIRS}, {run_sql('a', 's', 50)}, b AS (SELECT query_id, count(*) FILTER (WHERE score >= .3) AS n FROM a GROUP BY query_id) SELECT count(*) AS bags, count(*) FILTER (WHERE n = 0) AS empty, count(*) FILTER (WHERE n = 0) > 5 AS warned FROM b")
def dq5_early_check(t: Tables) -> DataFrame:
    b = run(t, 50).groupBy("query_id").agg(F.count_if(F.col("score") >= 0.3).alias("n"))
    return b.agg(F.count("*").alias("bags"), F.count_if(F.col("n") == 0).alias("empty"), (F.count_if(F.col("n") == 0) > 5).alias("warned"))


@query("SELECT column_name AS name FROM (DESCRIBE documents) WHERE column_name IN ('doc_id', 'text')")
def dq6_required_fields(t: Tables) -> DataFrame:
    have = t.documents.columns
    if missing := [c for c in ("doc_id", "text") if c not in have]:
        raise ValueError(f"documents lacks {', '.join(missing)}")
    return t.spark.createDataFrame([(c,) for c in have if c in ("doc_id", "text")], "name string")


@query("WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part) SELECT term, list_reduce(list_prepend('', string_split(substring(term, 1, 1) || translate(substring(term, 2), 'aeiouy', ''), '')), lambda x, c: CASE WHEN right(x, 1) = c THEN x ELSE x || c END) AS skeleton FROM w")
def p23_skeleton(t: Tables) -> DataFrame:
    w = t.part.select(F.explode(F.split("p_name", " ")).alias("term")).distinct()
    return w.select("term", T.skeleton(F.col("term")).alias("skeleton"))


def common_prefix(a, b):
    """The length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), n), lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))), F.lit(0))


@query("WITH v AS (SELECT DISTINCT p_name FROM part), p AS (SELECT a.p_name AS a, b.p_name AS b FROM v a JOIN v b ON split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1) AND a.p_name < b.p_name) SELECT a, b, CAST(list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda i: substr(a, 1, i) = substr(b, 1, i))) AS INTEGER) AS n FROM p")
def p26_char_overlap(t: Tables) -> DataFrame:
    v = t.part.select(F.col("p_name").alias("a")).distinct().withColumn("k", F.split("a", " ")[0])
    x = v.join(v.withColumnRenamed("a", "b"), "k").where("a < b")
    return x.select("a", "b", common_prefix(F.col("a"), F.col("b")).cast("int").alias("n"))


@query("SELECT page_id, regexp_matches(lower(url), '\\.(jpe?g|png|gif|mp[34]|webp)$') AS media, regexp_matches(lower(url), '\\.html?$') AS page FROM pages")
def p27_media_suffix(t: Tables) -> DataFrame:
    u = F.lower("url")
    return t.pages.select("page_id", u.rlike(r"\.(jpe?g|png|gif|mp[34]|webp)$").alias("media"), u.rlike(r"\.html?$").alias("page"))


WIKI = "p_name || chr(10) || '== Cast ==' || chr(10) || p_brand || chr(10) || '== Plot ==' || chr(10) || p_type || chr(10) || '=== Part ===' || chr(10) || p_brand || chr(10) || '== End ==' || chr(10) || 'x'"


@query("SELECT p_partkey, p_name AS lead, p_type || chr(10) || '=== Part ===' || chr(10) || p_brand AS plot FROM part")
def p31_lead_split(t: Tables) -> DataFrame:
    """The lead and the plot of articles, here made of a part's columns."""
    x = t.part.select("p_partkey", F.expr(WIKI.replace("chr(10)", "'\\n'")).alias("article"))
    return x.select("p_partkey", T.lead(F.col("article")).alias("lead"), T.section(F.col("article"), ("plot", "synopsis", "plot summary")).alias("plot"))


@query("SELECT event_id, round(value / 3, 4) AS x FROM events")
def p39_round(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(F.col("value") / 3, 4).alias("x"))


@query(f"WITH {PAIRS}, {run_sql('r', 's1', 10)} SELECT query_id, doc_id, score, rank FROM r")
def b16_teacher_targets(t: Tables) -> DataFrame:
    """The ten best under the teacher's vectors (the first half), as targets for another encoder."""
    return run(t, 10, 1)


@query(f"WITH {PAIRS}, {run_sql('bm', 's', 10)}, h AS (SELECT query_id, v[33:64] AS h FROM bm JOIN e ON e.vec_id = doc_id), u AS (SELECT query_id, list_transform(h, lambda x: x / sqrt(list_dot_product(h, h))) AS h FROM h), x AS (SELECT query_id, generate_subscripts(h, 1) AS dim, unnest(h) AS x FROM u), s AS (SELECT query_id, dim, sum(x) AS t, count(*) AS n FROM x GROUP BY ALL) SELECT query_id, any_value(n) AS n, round(sqrt(sum(t * t)) / any_value(n), 5) AS specificity FROM s GROUP BY query_id")
def b5_target_space_bags(t: Tables) -> DataFrame:
    """Bags picked by one encoder and described in another's space."""
    from ..operators import bags as B

    half = t.embeddings.select(F.col("vec_id").alias("doc_id"), V.unit(F.slice("embedding", 33, 32)).alias("v"))
    return B.describe(run(t, 10), half).select("query_id", "n", F.round("specificity", 5).alias("specificity"))


@query(f"""WITH {PAIRS}, {run_sql('r', 's', 100)}, d AS (SELECT doc_id, lower(text) AS x, list_distinct({content('text')}) AS k FROM documents WHERE doc_id IN (SELECT vec_id FROM e)), df AS (SELECT term, count(*) AS df FROM (SELECT unnest(k) AS term FROM d) GROUP BY term), w AS (SELECT doc_id AS query_id, unnest(k) AS term FROM d WHERE doc_id % 20 = 0 AND len(k) >= 2),
g AS (SELECT query_id, term AS entity FROM w JOIN df USING (term) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY df, term) = 1), q AS (SELECT query_id, entity, list_filter(k, lambda t: t <> entity) AS others FROM g JOIN d ON doc_id = query_id),
h AS (SELECT query_id, entity, count(x) FILTER (WHERE contains(x, entity) AND len(list_filter(others, lambda t: contains(x, t))) > 0) AS hits FROM q LEFT JOIN r USING (query_id) LEFT JOIN d USING (doc_id) GROUP BY ALL),
o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY entity ORDER BY query_id) = 1), z AS (SELECT query_id, entity, hits, CASE WHEN hits >= 70 THEN 'easy' WHEN hits >= 10 THEN 'mid' ELSE 'hard' END AS regime FROM o) SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY regime ORDER BY query_id) <= 15""")
def b17_regimes(t: Tables) -> DataFrame:
    """Queries by how many of their 100 nearest texts hold their rarest word and another of their words, as substrings; one per rarest word, 15 per regime."""
    d = t.documents.join(vectors(t).select("doc_id"), "doc_id", "left_semi").select("doc_id", F.lower("text").alias("x"), F.array_distinct(T.content_tokens(F.col("text"))).alias("k"))
    df = d.select(F.explode("k").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    own = d.where((F.col("doc_id") % 20 == 0) & (F.size("k") >= 2)).select(F.col("doc_id").alias("query_id"), "k")
    rarest = own.select("query_id", F.explode("k").alias("term")).join(df, "term").groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("entity"))
    q = rarest.join(own, "query_id").select("query_id", "entity", F.array_remove("k", F.col("entity")).alias("others"))
    near = q.join(run(t, 100), "query_id", "left").join(d.select("doc_id", "x"), "doc_id", "left")
    both = F.contains("x", F.col("entity")) & F.exists("others", lambda w: F.contains(F.col("x"), w))
    hits = near.groupBy("query_id", "entity").agg(F.count_if(both).alias("hits"))
    one = first_by(hits, ["entity"], ["query_id"]).withColumn("regime", F.when(F.col("hits") >= 70, "easy").when(F.col("hits") >= 10, "mid").otherwise("hard"))
    place = F.row_number().over(Window.partitionBy("regime").orderBy("query_id"))
    return one.withColumn("n", place).where("n <= 15").select("query_id", "entity", "hits", "regime")


@query(f"WITH {PAIRS}, {QRELS}, v AS (SELECT y.query_id, y.doc_id FROM j y WHERE grade < 2 AND EXISTS (SELECT 1 FROM j x WHERE x.query_id = y.query_id AND x.grade >= 2 AND x.s < y.s)), p AS (SELECT j.doc_id % 2 = 0 AS feature, v.doc_id IS NOT NULL AS violates FROM j LEFT JOIN v USING (query_id, doc_id) WHERE grade < 2) SELECT count(*) FILTER (WHERE feature AND violates) AS a, count(*) FILTER (WHERE feature AND NOT violates) AS b, count(*) FILTER (WHERE NOT feature AND violates) AS c, count(*) FILTER (WHERE NOT feature AND NOT violates) AS d FROM p")
def m21_violation_profile(t: Tables) -> DataFrame:
    """A feature among violations and others, as a table of two by two."""
    x = graded(t)
    least = F.min(F.when(F.col("grade") >= 2, F.col("score"))).over(Window.partitionBy("query_id"))
    x = x.withColumn("violates", F.coalesce(F.col("score") > least, F.lit(False))).where("grade < 2").withColumn("feature", F.col("doc_id") % 2 == 0)
    f, v = F.col("feature"), F.col("violates")
    return x.agg(F.count_if(f & v).alias("a"), F.count_if(f & ~v).alias("b"), F.count_if(~f & v).alias("c"), F.count_if(~f & ~v).alias("d"))


@query(f"WITH {PAIRS}, {QRELS} SELECT count(DISTINCT query_id) AS anchors, count(DISTINCT doc_id) FILTER (WHERE grade >= 2) AS positives, count(DISTINCT doc_id) FILTER (WHERE grade = 0) AS negatives FROM j")
def m22_triplet_yield(t: Tables) -> DataFrame:
    return qrels(t).agg(F.countDistinct("query_id").alias("anchors"), F.countDistinct(F.when(F.col("grade") >= 2, F.col("doc_id"))).alias("positives"), F.countDistinct(F.when(F.col("grade") == 0, F.col("doc_id"))).alias("negatives"))


@query(f"WITH {PAIRS}, {QRELS}, c AS (SELECT x.query_id, y.s1 >= 0 AS high, round(avg(CASE WHEN y.s > x.s THEN 1.0 WHEN y.s = x.s THEN .5 ELSE 0 END), 6) AS beats FROM j x JOIN j y ON x.query_id = y.query_id AND x.grade >= 2 AND y.grade = 0 GROUP BY ALL) SELECT a.query_id, a.beats AS high_beats, b.beats AS low_beats FROM c a JOIN c b ON a.query_id = b.query_id AND a.high AND NOT b.high")
def m23_overlap_beats(t: Tables) -> DataFrame:
    """How often judged-bad documents of high and of low overlap beat good ones, for queries that have both."""
    g = graded(t)
    s1 = D.rescore(g, asked(t), vectors(t), (0, 32)).withColumnRenamed("score", "s1")
    x = g.join(s1, M.KEY)
    side = lambda c, name: M.pairwise(x.where((F.col("grade") >= 2) | (F.col("grade") == 0) & c), F.col("grade") == 0, F.col("grade") >= 2).select("query_id", F.col("concordance").alias(name))
    return side(F.col("s1") >= 0, "high_beats").join(side(F.col("s1") < 0, "low_beats"), "query_id")


@query(f"WITH {PAIRS}, {QRELS} SELECT grade, count(*) AS n, CASE WHEN count(*) >= 10 THEN round(corr(s, s1), 5) END AS r FROM j GROUP BY grade")
def m27_correlation_by_label(t: Tables) -> DataFrame:
    g = graded(t)
    s1 = D.rescore(g, asked(t), vectors(t), (0, 32)).withColumnRenamed("score", "s1")
    x = g.join(s1, M.KEY).groupBy("grade").agg(F.count("*").alias("n"), S.pearson(F.col("score"), F.col("s1")).alias("r"))
    return x.select("grade", "n", F.round(F.when(F.col("n") >= 10, F.col("r")), 5).alias("r"))


@query("WITH x AS (SELECT doc_id, quality * 2 + (1 - toxic) AS grade FROM labels) SELECT grade, count(*) AS n FROM x GROUP BY grade")
def io11_label_grades(t: Tables) -> DataFrame:
    return t.labels.groupBy((F.col("quality") * 2 + (1 - F.col("toxic"))).alias("grade")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE p_size = 7")
def io6_pruned_scan(t: Tables) -> DataFrame:
    from ..sources import io

    return io.parquet(t.spark, f"{t.sf_dir}/part.parquet", ["p_partkey", "p_name"], "p_size = 7")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def io17_pending(t: Tables) -> DataFrame:
    from ..sources import io

    return io.pending(t.documents.select("doc_id"), t.labels, ["doc_id"])


@query(f"""WITH {PAIRS}, {run_sql('r', 's', 20)}, d AS (SELECT doc_id, {content('text')} AS k FROM documents WHERE doc_id IN (SELECT vec_id FROM e)), w AS (SELECT doc_id AS query_id, list_sort(list_transform(list_distinct(k), lambda x: lpad(CAST(length(x) AS VARCHAR), 6, '0') || x), 'DESC')[1][7:] AS term FROM d WHERE doc_id % 20 = 0 AND len(k) > 0),
h AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM w JOIN d ON list_contains(k, term) AND doc_id <> query_id QUALIFY rank <= 20),
u AS (SELECT query_id, doc_id, rank, 0 AS tier FROM h UNION ALL SELECT query_id, doc_id, rank, 1 FROM r), x AS (SELECT u.*, array_to_string(k[1:3], ' ') AS title FROM u JOIN d USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, title ORDER BY tier, rank) = 1)
SELECT query_id, doc_id, tier, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank) AS rank FROM x""")
def r8_keyword_first_union(t: Tables) -> DataFrame:
    """Candidates by a text's longest word, then by its vector; of one title (three words) the first, keywords before others."""
    d = t.documents.join(vectors(t).select("doc_id"), "doc_id", "left_semi").select("doc_id", T.content_tokens(F.col("text")).alias("k"))
    words = d.where((F.col("doc_id") % 20 == 0) & (F.size("k") > 0)).select(F.col("doc_id").alias("query_id"), F.explode("k").alias("term"))
    longest = words.groupBy("query_id").agg(F.max_by("term", F.struct(F.length("term"), "term")).alias("term"))
    post = d.select("doc_id", F.explode(F.array_distinct("k")).alias("term"))
    by = Window.partitionBy("query_id").orderBy("doc_id")
    hits = post.join(longest, "term").where("doc_id <> query_id").withColumn("rank", F.row_number().over(by)).where("rank <= 20")
    titles = d.select("doc_id", F.array_join(F.slice("k", 1, 3), " ").alias("title"))
    return U.keyword_first(hits, run(t, 20), titles)


EXPANDED = "b AS (SELECT p_partkey AS doc_id, string_split(p_name, ' ') AS tokens FROM part), x AS (SELECT p_partkey AS doc_id, string_split(lower(p_type), ' ') AS tokens FROM part UNION ALL SELECT p_partkey, string_split(lower(p_brand), ' ') FROM part)"


def expandable(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Documents (names of parts) and texts given for them from outside (type and brand)."""
    split = lambda c: F.split(F.lower(c), " ").alias("tokens")
    given = [t.part.select(F.col("p_partkey").alias("doc_id"), split(c)) for c in ("p_type", "p_brand")]
    return t.part.select(F.col("p_partkey").alias("doc_id"), F.split("p_name", " ").alias("tokens")), given[0].unionByName(given[1])


EXPANDING = "q AS (SELECT row_number() OVER (ORDER BY p_type) AS query_id, string_split(lower(p_type), ' ') AS tokens FROM (SELECT DISTINCT p_type FROM part))"


def expansion_queries(t: Tables) -> DataFrame:
    """The types of parts, of which there is a fixed number, as queries."""
    x = t.part.select("p_type").distinct()
    return x.select(F.row_number().over(Window.orderBy("p_type")).cast("long").alias("query_id"), F.split(F.lower("p_type"), " ").alias("tokens"))


@query(f"WITH {EXPANDED}, {EXPANDING}, d AS (SELECT doc_id, flatten(list(tokens)) AS tokens FROM (SELECT * FROM b UNION ALL SELECT * FROM x) GROUP BY doc_id), {bm25_sql(0.3, 0.6, 'd', 'q')} {RANKED}")
def r19_expanded_documents(t: Tables) -> DataFrame:
    """Each document searched together with the texts given for it."""
    docs, given = expandable(t)
    return L.top_k(L.bm25(expansion_queries(t), L.expanded(docs, given)), 10)


@query(f"WITH {EXPANDED}, {EXPANDING}, {bm25_sql(0.3, 0.6, 'b', 'q', 'sb')}, y AS (SELECT doc_id * 1000 + row_number() OVER (PARTITION BY doc_id ORDER BY tokens) AS doc_id, tokens FROM x), {bm25_sql(0.3, 0.6, 'y', 'q', 'sx')}, scored AS (SELECT query_id, doc_id, max(score) AS score FROM (SELECT * FROM sb UNION ALL SELECT query_id, doc_id // 1000, score FROM sx) GROUP BY ALL) {RANKED}")
def r19_best_expansion(t: Tables) -> DataFrame:
    """The best of a document's own score and those of each text given for it."""
    docs, given = expandable(t)
    return L.top_k(L.bm25_best(expansion_queries(t), docs, given), 10)
