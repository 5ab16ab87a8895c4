"""Bags and the readiness of a corpus: cluster hypothesis, spread, expected lift, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import bags as B
from ..operators import dense as D
from ..operators import readiness as R
from .dense import PAIRS, run, run_sql, vectors
from .metrics import QRELS, RUNS, judged_sums, mean_product, pair_extremes, parts, qrels, recalls, sets, widened
from .registry import Tables, query

BAGS = f"WITH {PAIRS}, {QRELS}, p AS (SELECT query_id, doc_id, grade, count(*) OVER (PARTITION BY query_id) AS n0, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS place FROM j WHERE grade >= 2), bm AS (SELECT query_id, doc_id, grade, place FROM p WHERE n0 >= 2 AND place <= 50)"
CENTRES = "bx AS (SELECT query_id, generate_subscripts(v, 1) AS dim, unnest(v) AS x FROM bm JOIN e ON e.vec_id = doc_id), bc AS (SELECT query_id, dim, avg(x) AS c FROM bx GROUP BY ALL), bl AS (SELECT query_id, list(c ORDER BY dim) AS c FROM bc GROUP BY query_id), bags AS (SELECT bm.query_id, count(*) AS n, avg(list_cosine_similarity(e.v, bl.c)) AS spec FROM bm JOIN e ON e.vec_id = doc_id JOIN bl ON bl.query_id = bm.query_id GROUP BY bm.query_id)"


def described(t: Tables) -> DataFrame:
    return B.describe(B.members(qrels(t)), vectors(t))


@query(f"{BAGS}, {CENTRES} SELECT query_id, n, round(spec, 6) AS specificity FROM bags")
def b1_bags_from_qrels(t: Tables) -> DataFrame:
    return described(t).select("query_id", "n", F.round("specificity", 6).alias("specificity"))


@query(f"WITH {PAIRS}, {run_sql('a', 's', 50)}, bm AS (SELECT query_id, doc_id FROM a WHERE score >= 0.2), {CENTRES} SELECT e.vec_id AS query_id, coalesce(n, 0) AS n, round(coalesce(spec, 0), 6) AS specificity FROM e LEFT JOIN bags ON bags.query_id = e.vec_id WHERE e.vec_id % 20 = 0")
def b2_bags_from_retrieval(t: Tables) -> DataFrame:
    """Members by a score threshold; a query without any keeps an empty bag."""
    b = B.describe(run(t, 50).where("score >= 0.2"), vectors(t))
    x = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id")).join(b, "query_id", "left")
    return x.select("query_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(F.coalesce("specificity", F.lit(0.0)), 6).alias("specificity"))


@query("WITH c AS (SELECT DISTINCT user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS item FROM events WHERE event_type = 'click'), g AS (SELECT item, count(*) AS n FROM c GROUP BY item HAVING count(*) >= 2) SELECT item, n, CAST(('0x' || substr(md5(CAST(item AS VARCHAR)), 1, 8)) AS BIGINT) % 1000 < 800 AS train FROM g")
def b3_click_bags(t: Tables) -> DataFrame:
    """Items with at least two clicking users, split by a hash of the item."""
    c = t.events.where("event_type = 'click'").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("item")).distinct()
    split = F.conv(F.substring(F.md5(F.col("item").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 1000 < 800
    return c.groupBy("item").agg(F.count("*").alias("n")).where("n >= 2").select("item", "n", split.alias("train"))


def ratings(t: Tables) -> DataFrame:
    """(u, m): the distinct items that a user rates highly."""
    r = t.lineitem.where("l_quantity >= 35").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return r.select(F.col("o_custkey").alias("u"), F.col("l_partkey").alias("m")).distinct()


def corated(t: Tables) -> DataFrame:
    """(m1, m2, n): users that both items have in common.

    Ratings are distinct before they meet, and users of many items are split: each of a
    user's items meets the others by user and a salt of the first item.
    """
    r = ratings(t)
    left = r.select("u", F.col("m").alias("m1"), F.pmod(F.xxhash64("m"), F.lit(8)).alias("salt"))
    right = r.select("u", F.col("m").alias("m2"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("salt"))
    return left.join(right, ["u", "salt"]).where("m1 <> m2").groupBy("m1", "m2").agg(F.count("*").alias("n"))


def cooccurring(t: Tables) -> DataFrame:
    """The 50 items most often rated with each, then those with at least 5 users."""
    top = corated(t).withColumn("place", F.row_number().over(Window.partitionBy("m1").orderBy(F.desc("n"), "m2"))).where("place <= 50")
    return top.where("n >= 5").select("m1", "m2", "n")


def corated_bags(pairs: DataFrame) -> DataFrame:
    x = pairs.groupBy("m1").agg(F.count("*").alias("size"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "m2"))).alias("l")).where("size >= 2")
    return x.select("m1", "size", F.array_join(F.transform("l", lambda s: s["m2"].cast("string")), ",").alias("members"))


def pair_count(t: Tables) -> DataFrame:
    """The ordered pairs of a user's items, counted from group sizes without making them."""
    n = ratings(t).groupBy("u").agg(F.count("*").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1)).alias("n_pairs"))
    return n.select("n_pairs", F.col("n_pairs").alias("total"))


ITEMS = "r AS (SELECT DISTINCT o_custkey AS u, l_partkey AS m FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 35), c AS (SELECT x.m AS m1, y.m AS m2, count(*) AS n FROM r x JOIN r y ON x.u = y.u AND x.m <> y.m GROUP BY ALL), k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY m1 ORDER BY n DESC, m2) <= 50)"


@query(f"WITH {ITEMS} SELECT m1, m2, n FROM k WHERE n >= 5")
def a10_item_cooccurrence(t: Tables) -> DataFrame:
    return cooccurring(t)


@query(f"WITH {ITEMS} SELECT m1, count(*) AS size, string_agg(CAST(m2 AS VARCHAR), ',' ORDER BY n DESC, m2) AS members FROM k WHERE n >= 5 GROUP BY m1 HAVING count(*) >= 2")
def b4_item_bags(t: Tables) -> DataFrame:
    return corated_bags(a10_item_cooccurrence(t))


@query(f"WITH {ITEMS} SELECT CAST(sum(n) AS BIGINT) AS n_pairs, CAST(sum(n) AS BIGINT) AS total FROM c")
def j8_item_pairs(t: Tables) -> DataFrame:
    return pair_count(t)


@query(f"WITH {PAIRS}, {run_sql('a', 's', 50)}, bm AS (SELECT query_id, doc_id FROM a WHERE score >= 0.25), {CENTRES} SELECT query_id, n, round(spec, 6) AS specificity FROM bags")
def b6_filter_bags(t: Tables) -> DataFrame:
    return B.describe(run(t, 50).where("score >= 0.25"), vectors(t)).select("query_id", "n", F.round("specificity", 6).alias("specificity"))


@query(f"WITH {PAIRS}, {run_sql('a', 's', 50)}, x AS (SELECT query_id, count(*) FILTER (WHERE score >= 0.3) AS n FROM a GROUP BY query_id) SELECT query_id, n FROM x WHERE n > 0")
def b7_strip_empty(t: Tables) -> DataFrame:
    return run(t, 50).groupBy("query_id").agg(F.count_if(F.col("score") >= 0.3).alias("n")).where("n > 0")


@query(f"{BAGS}, h AS (SELECT query_id, doc_id, v[1:32] AS h FROM bm JOIN e ON e.vec_id = doc_id), u AS (SELECT query_id, list_transform(h, lambda x: x / sqrt(list_dot_product(h, h))) AS h FROM h), x AS (SELECT query_id, generate_subscripts(h, 1) AS dim, unnest(h) AS x FROM u), m AS (SELECT query_id, dim, avg(x) AS c FROM x GROUP BY ALL), l AS (SELECT query_id, list(c ORDER BY dim) AS c FROM m GROUP BY query_id) SELECT u.query_id, round(avg(list_cosine_similarity(h, c)), 6) AS specificity FROM u JOIN l USING (query_id) GROUP BY u.query_id")
def b8_other_encoder(t: Tables) -> DataFrame:
    """The bags' centroids under another encoder: the first half of the vector."""
    half = t.embeddings.select(F.col("vec_id").alias("doc_id"), V.unit(F.slice("embedding", 1, 32)).alias("v"))
    return B.describe(B.members(qrels(t)), half).select("query_id", F.round("specificity", 6).alias("specificity"))


NEG = "SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM n QUALIFY place <= 10"


@query(f"{RUNS}, n AS (SELECT b.query_id, b.doc_id, b.rank FROM b WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.query_id = b.query_id AND j.doc_id = b.doc_id AND grade >= 2)) {NEG}")
def b9_hard_negatives(t: Tables) -> DataFrame:
    return B.hard_negatives(run(t, 100, 1), qrels(t).where("grade >= 2")).select("query_id", "doc_id", "place")


@query(f"{RUNS}, n AS (SELECT a.query_id, a.doc_id, a.rank FROM a WHERE rank > 5 AND NOT EXISTS (SELECT 1 FROM j WHERE j.query_id = a.query_id AND j.doc_id = a.doc_id AND grade >= 2)) {NEG}")
def b10_dense_hardnegs(t: Tables) -> DataFrame:
    return B.hard_negatives(run(t, 100), qrels(t).where("grade >= 2"), skip=5).select("query_id", "doc_id", "place")


@query(f"WITH {PAIRS}, {QRELS}, z AS (SELECT query_id, doc_id, md5(query_id || ':' || doc_id) AS h FROM j WHERE grade < 2) SELECT query_id, doc_id FROM z QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY h) <= 10")
def b11_random_hardnegs(t: Tables) -> DataFrame:
    h = F.md5(F.concat_ws(":", "query_id", "doc_id").cast("binary"))
    return qrels(t).where("grade < 2").withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(h))).where("n <= 10").select("query_id", "doc_id")


@query(f"WITH {PAIRS}, {QRELS} SELECT query_id, count(*) FILTER (WHERE grade = 3) AS positives, count(*) FILTER (WHERE grade = 0) AS negatives FROM j GROUP BY query_id HAVING count(*) FILTER (WHERE grade = 3) > 0 AND count(*) FILTER (WHERE grade = 0) > 0")
def b12_triplets(t: Tables) -> DataFrame:
    return B.triplets(qrels(t), F.col("grade") == 3, F.col("grade") == 0)


@query(f"WITH {PAIRS}, {QRELS} SELECT query_id, count(*) FILTER (WHERE grade = 3) AS positives, count(*) FILTER (WHERE grade < 2) AS negatives FROM j GROUP BY query_id HAVING positives > 0 AND negatives > 0")
def b12b_triplets_wide(t: Tables) -> DataFrame:
    return B.triplets(qrels(t), F.col("grade") == 3, F.col("grade") < 2)


#: Cohesion by corpus: `m` is the judgments with vectors and `corpus`, `exp` the queries with negatives too.
COHESION = """ok AS (SELECT corpus, query_id FROM m WHERE grade >= 2 GROUP BY ALL HAVING count(*) >= 2),
i AS (SELECT x.corpus, x.query_id, avg(list_dot_product(x.v, y.v)) AS intra, max(round(list_dot_product(x.v, y.v), 6)) AS pp_max FROM m x JOIN m y ON x.query_id = y.query_id AND x.doc_id < y.doc_id AND x.grade >= 2 AND y.grade >= 2 JOIN ok ON ok.query_id = x.query_id GROUP BY ALL),
g AS (SELECT x.query_id, avg(list_dot_product(x.v, y.v)) AS neg, max(round(list_dot_product(x.v, y.v), 6)) AS pn_max FROM m x JOIN m y ON x.query_id = y.query_id AND x.grade >= 2 AND y.grade = 0 JOIN ok ON ok.query_id = x.query_id GROUP BY x.query_id),
touched AS (SELECT DISTINCT corpus, doc_id, v FROM m), rnd AS (SELECT x.corpus, avg(list_dot_product(x.v, y.v)) AS rand FROM touched x JOIN touched y ON x.corpus = y.corpus AND x.doc_id < y.doc_id GROUP BY x.corpus),
w AS (SELECT i.corpus, count(*) AS n, avg(intra) AS intra, count(neg) AS n_exp, avg(CASE WHEN neg IS NOT NULL THEN intra END) AS intra_exp, avg(neg) AS neg, avg(CASE WHEN neg IS NOT NULL THEN CAST(pn_max > pp_max AS INTEGER) END) AS strong FROM i LEFT JOIN g ON g.query_id = i.query_id GROUP BY i.corpus),
cohesion AS (SELECT w.*, rand, (intra - rand) / greatest(1 - rand, 1e-6) AS schs FROM w JOIN rnd USING (corpus))"""


def judged_vectors(corpus: str) -> str:
    return f"m AS (SELECT query_id, doc_id, grade, v, {corpus} AS corpus FROM j JOIN e ON e.vec_id = doc_id)"


CHS = f"WITH {PAIRS}, {QRELS}, {judged_vectors('0')}, {COHESION}"


def chs(t: Tables, judged: DataFrame, ids: str = "doc_id", groups: str = "query_id") -> DataFrame:
    """By corpus: n, intra, rand, schs, and over the groups with negatives n_exp, intra_exp, neg.

    Mean pairwise cosines within positives, to negatives, and among all touched. All are
    sums over vector sums: no pair is ever made. judged has a column corpus.
    """
    v = t.embeddings.select(F.col("vec_id").alias(ids), F.col("embedding").alias("v"))
    m = judged.join(v, ids)
    p = V.sums(m.where("grade >= 2").select("corpus", groups, "v"), ["corpus", groups]).where("n >= 2")
    q = V.sums(m.where("grade = 0").select(groups, "v"), [groups]).select(groups, F.col("total").alias("nt"), F.col("n").alias("nn"))
    each = p.join(q, groups, "left").select("corpus", V.coherence(F.col("total"), F.col("n")).alias("x"), (V.dot(F.col("total"), F.col("nt")) / (F.col("n") * F.col("nn"))).alias("y"))
    has = F.col("y").isNotNull()
    within = each.groupBy("corpus").agg(F.count("*").alias("n"), F.avg("x").alias("intra"), F.count("y").alias("n_exp"), F.avg(F.when(has, F.col("x"))).alias("intra_exp"), F.avg("y").alias("neg"))
    touched = V.sums(v.join(judged.select("corpus", ids).distinct(), ids), ["corpus"]).select("corpus", V.coherence(F.col("total"), F.col("n")).alias("rand"))
    schs = (F.col("intra") - F.col("rand")) / F.greatest(1 - F.col("rand"), F.lit(1e-6))
    return within.join(touched, "corpus").withColumn("schs", schs)


def one_corpus(judged: DataFrame) -> DataFrame:
    return judged.withColumn("corpus", F.lit(0).cast("long"))


@query(f"{CHS} SELECT n, round(intra, 5) AS intra, round(rand, 5) AS rand, round(schs, 5) AS schs, CASE WHEN schs >= .5 THEN 'GREEN' WHEN schs >= .4 THEN 'YELLOW' ELSE 'RED' END AS verdict, n < 500 AS small FROM cohesion")
def c5_chs(t: Tables) -> DataFrame:
    x = chs(t, one_corpus(qrels(t)))
    return x.select("n", *(F.round(c, 5).alias(c) for c in ("intra", "rand", "schs")), R.colour(F.col("schs")).alias("verdict"), (F.col("n") < 500).alias("small"))


EXPLICIT = "SELECT n_exp, CASE WHEN n_exp >= {least} THEN round(intra_exp, 5) END AS intra_exp, CASE WHEN n_exp >= {least} THEN round(neg, 5) END AS neg, CASE WHEN n_exp >= {least} THEN round((intra_exp - neg) / greatest(intra_exp - rand, 1e-6), 5) END AS hchs, CASE WHEN n_exp >= {least} THEN round(strong, 5) END AS strong_inversions FROM cohesion"


def explicit(t: Tables, least: int) -> DataFrame:
    """HCHS and the share of strong inversions over queries with explicit negatives; null for fewer than `least` of them."""
    (pt, _, pn), (nt, _, nn) = parts("p"), parts("n")
    x = judged_sums(t).where(pn >= 2).select("query_id", mean_product("p").alias("x"), (V.dot(pt, nt) / (pn * nn)).alias("y"))
    pairs = pair_extremes(t).where("pp_max IS NOT NULL AND pn IS NOT NULL").select("query_id", F.when(F.col("pn.s") > F.col("pp_max"), 1.0).otherwise(0.0).alias("strong"))
    has = F.col("y").isNotNull()
    means = x.join(pairs, "query_id", "left").withColumn("corpus", F.lit(0)).groupBy("corpus").agg(F.count("y").alias("n_exp"), F.avg(F.when(has, F.col("x"))).alias("intra_exp"), F.avg("y").alias("neg"), F.avg(F.when(has, F.col("strong"))).alias("strong"))
    v, q = sets(t)
    asking = q.groupBy("g").agg(F.count("*").alias("asking"), F.min("query_id").alias("one"))
    touched = v.join(asking, "g").where("v IS NOT NULL AND (asking > 1 OR doc_id <> one)").select(widened(F.col("v")).alias("v"), F.lit(0).alias("corpus"))
    rand = V.sums(touched, ["corpus"]).select("corpus", F.when(F.element_at("total", -1) >= 2, mean_product("total")).otherwise(0.0).alias("rand"))
    hchs = (F.col("intra_exp") - F.col("neg")) / F.greatest(F.col("intra_exp") - F.col("rand"), F.lit(1e-6))
    shown = {"intra_exp": F.col("intra_exp"), "neg": F.col("neg"), "hchs": hchs, "strong_inversions": F.col("strong")}
    return means.join(rand, "corpus").select("n_exp", *(F.when(F.col("n_exp") >= least, F.round(c, 5)).alias(name) for name, c in shown.items()))


@query(f"{CHS} {EXPLICIT.format(least=50)}")
def c5_hchs(t: Tables) -> DataFrame:
    return explicit(t, 50)


@query(f"{CHS} {EXPLICIT.format(least=10)}")
def c5_hchs_few(t: Tables) -> DataFrame:
    """The same for corpora of few queries: ten of them are enough."""
    return explicit(t, 10)


@query(f"""WITH {PAIRS}, {QRELS}, m AS (SELECT doc_id, query_id, v FROM j JOIN e ON e.vec_id = query_id WHERE grade >= 2), ok AS (SELECT doc_id FROM m GROUP BY doc_id HAVING count(*) >= 2),
i AS (SELECT x.doc_id, avg(list_dot_product(x.v, y.v)) AS intra FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.query_id < y.query_id JOIN ok ON ok.doc_id = x.doc_id GROUP BY x.doc_id), tq AS (SELECT DISTINCT vec_id, v FROM j JOIN e ON e.vec_id = query_id), r AS (SELECT avg(list_dot_product(x.v, y.v)) AS rand FROM tq x JOIN tq y ON x.vec_id < y.vec_id)
SELECT count(*) AS n, round(avg(intra), 5) AS intra, round(any_value(rand), 5) AS rand, round((avg(intra) - any_value(rand)) / greatest(1 - any_value(rand), 1e-6), 5) AS schs FROM i, r""")
def c7_query_side_chs(t: Tables) -> DataFrame:
    """The same with roles swapped: a document as the set of its queries."""
    x = chs(t, one_corpus(qrels(t)), ids="query_id", groups="doc_id")
    return x.select("n", *(F.round(c, 5).alias(c) for c in ("intra", "rand", "schs")))


@query(f"{BAGS}, {CENTRES} SELECT count(*) AS n_bags, median(n) AS median_size, round(median(spec), 6) AS median_spec FROM bags")
def c8_bag_stats(t: Tables) -> DataFrame:
    return described(t).agg(F.count("*").alias("n_bags"), F.median("n").alias("median_size"), F.round(F.median("specificity"), 6).alias("median_spec"))


def ready_sql(corpus: str) -> str:
    """CTEs to `z`: a row per corpus with bag statistics, base difficulty at 10, predicted rescue, cohesion and lifts."""
    return f"""{BAGS}, {CENTRES}, {run_sql('a', 's', 100)}, {run_sql('b', 's1', 100)}, {judged_vectors(corpus)}, {COHESION},
h AS (SELECT query_id, {corpus} AS corpus, count(*) AS n, count(a.rank) FILTER (WHERE a.rank <= 10) / count(*) AS ra, count(b.rank) FILTER (WHERE b.rank <= 10) / count(*) AS rb FROM j LEFT JOIN a USING (query_id, doc_id) LEFT JOIN b USING (query_id, doc_id) WHERE grade >= 2 GROUP BY ALL),
bs AS (SELECT {corpus} AS corpus, count(*) AS n_bags, median(n) AS size, median(spec) AS spec FROM bags GROUP BY ALL),
d AS (SELECT corpus, count(*) AS n_queries, avg(ra) AS r, avg(CASE WHEN ra = 0 THEN 1.0 ELSE 0 END) AS blind, avg(CASE WHEN ra = 1 THEN 1.0 ELSE 0 END) AS perfect, avg(rb) AS rb FROM h GROUP BY corpus),
z0 AS (SELECT d.*, coalesce(n_bags, 0) AS n_bags, size, spec, schs, CASE WHEN n_bags >= 10 AND r < .85 THEN least(greatest((5.459 * log10(n_bags) - .014 * size + 52.137 * spec - 46.872) / 100, 0), .4) END AS rescue FROM d LEFT JOIN bs USING (corpus) LEFT JOIN cohesion USING (corpus)),
z AS (SELECT *, blind * CASE WHEN rescue IS NULL THEN .05 ELSE greatest(rescue - .0266, 0) END - perfect * .15 * (1 - r) AS pessimistic, blind * coalesce(rescue, .12) - perfect * .10 * (1 - r) AS realistic, blind * coalesce(rescue + .0266, .25) - perfect * .06 * (1 - r) AS optimistic FROM z0)"""


READY = ready_sql("0")
VERDICT = "CASE WHEN n_bags = 0 OR schs < .4 THEN 'SKIP' WHEN realistic > .01 AND optimistic >= .05 THEN 'GO' WHEN realistic > .01 THEN 'CONDITIONAL' ELSE 'SKIP' END"
ZONE = "CASE WHEN schs >= .3 AND schs < .4 AND rescue >= .15 THEN 'high-rescue' WHEN schs >= .3 AND schs < .4 AND perfect < .05 THEN 'low-tax' END"


def report(t: Tables, corpus=None) -> DataFrame:
    """A row per corpus: bag statistics, base difficulty at 10, predicted rescue, cohesion and lift by scenario."""
    at = (F.lit(0) if corpus is None else corpus).cast("long").alias("corpus")
    s = described(t).groupBy(at).agg(F.count("*").alias("n_bags"), F.median("n").alias("size"), F.median("specificity").alias("spec"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    d = recalls(t, 10).groupBy(at).agg(F.count("*").alias("n_queries"), F.avg("ra").alias("r"), share(F.col("ra") == 0).alias("blind"), share(F.col("ra") == 1).alias("perfect"), F.avg("rb").alias("rb"))
    cohesion = chs(t, qrels(t).withColumn("corpus", at)).select("corpus", "schs")
    x = d.join(s, "corpus", "left").join(cohesion, "corpus", "left").withColumn("n_bags", F.coalesce("n_bags", F.lit(0)))
    x = x.withColumn("rescue", R.rescue(F.col("n_bags"), F.col("size"), F.col("spec"), F.col("r")))
    return x.withColumns({c: R.lift(c, F.col("blind"), F.col("perfect"), F.col("r"), F.col("rescue")) for c in R.SCENARIOS})


@query(f"{READY} SELECT n_bags, round(r, 6) AS base, round(rescue, 6) AS rescue FROM z")
def c9_rescue(t: Tables) -> DataFrame:
    return report(t).select("n_bags", F.round("r", 6).alias("base"), F.round("rescue", 6).alias("rescue"))


@query(f"{READY} SELECT scenario, round(lift, 6) AS lift FROM (UNPIVOT (SELECT pessimistic, realistic, optimistic FROM z) ON pessimistic, realistic, optimistic INTO NAME scenario VALUE lift)")
def c10_lift_bands(t: Tables) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("scenario"), F.round(c, 6).alias("lift")) for c in R.SCENARIOS))).alias("x")
    return report(t).select(each).select("x.scenario", "x.lift")


@query(f"{READY} SELECT {VERDICT} AS verdict, {ZONE} AS false_skip, n_bags, round(schs, 5) AS schs, round(optimistic, 6) AS optimistic, round(realistic, 6) AS realistic FROM z")
def c11_verdict(t: Tables) -> DataFrame:
    schs, n = F.col("schs"), F.col("n_bags")
    v = R.verdict(schs, n, F.col("realistic"), F.col("optimistic")).alias("verdict")
    return report(t).select(v, R.false_skip(schs, F.col("perfect"), F.col("rescue")).alias("false_skip"), "n_bags", F.round(schs, 5).alias("schs"), F.round("optimistic", 6).alias("optimistic"), F.round("realistic", 6).alias("realistic"))


@query(f"{READY} SELECT round(r, 6) AS base, round(rb, 6) AS other, CASE WHEN rb > r + .02 THEN 'other' WHEN rb < r - .02 THEN 'base' ELSE 'hybrid' END AS architecture FROM z")
def c12_architecture(t: Tables) -> DataFrame:
    a, b = F.col("r"), F.col("rb")
    return report(t).select(F.round(a, 6).alias("base"), F.round(b, 6).alias("other"), F.when(b > a + 0.02, "other").when(b < a - 0.02, "base").otherwise("hybrid").alias("architecture"))


@query(f"{ready_sql('query_id % 40 // 20')} SELECT corpus, n_queries, round(r, 6) AS base, round(blind, 6) AS blind, round(perfect, 6) AS perfect, n_bags, size AS median_size, round(spec, 6) AS median_spec, round(rescue, 6) AS rescue, round(realistic, 6) AS realistic, round(optimistic, 6) AS optimistic, round(schs, 5) AS schs, {VERDICT} AS verdict FROM z")
def c13_corpus_sweep(t: Tables) -> DataFrame:
    """The whole report by corpus; two corpora by query here."""
    x = report(t, F.floor(F.col("query_id") % 40 / 20))
    v = R.verdict(F.col("schs"), F.col("n_bags"), F.col("realistic"), F.col("optimistic")).alias("verdict")
    six = lambda c, name=None: F.round(c, 6).alias(name or c)
    return x.select("corpus", "n_queries", six("r", "base"), six("blind"), six("perfect"), "n_bags", F.col("size").alias("median_size"), six("spec", "median_spec"), six("rescue"), six("realistic"), six("optimistic"), F.round("schs", 5).alias("schs"), v)


@query(f"WITH {PAIRS}, {QRELS} SELECT query_id, count(*) FILTER (WHERE grade >= 2) AS strict_pos, count(*) FILTER (WHERE grade = 0) AS strict_neg, count(*) FILTER (WHERE grade >= 1) AS relaxed_pos, count(*) FILTER (WHERE grade <= 0) AS relaxed_neg, count(*) FILTER (WHERE grade >= 2) >= 2 AS eligible FROM j GROUP BY query_id")
def c1_partition(t: Tables) -> DataFrame:
    """Positives and negatives under the strict and the relaxed reading, at a positive grade of 2."""
    n = lambda c, name: F.count_if(c).alias(name)
    g, pos, neg = F.col("grade"), 2, 0
    return qrels(t).groupBy("query_id").agg(n(g >= pos, "strict_pos"), n(g <= neg, "strict_neg"), n(g >= max(1, pos - 1), "relaxed_pos"), n(g <= min(neg + 1, pos - 2), "relaxed_neg"), (F.count_if(g >= pos) >= 2).alias("eligible"))


@query(f"""{RUNS}, k AS (SELECT * FROM a WHERE rank <= 10 UNION ALL SELECT * FROM b WHERE rank <= 10), o AS (SELECT query_id, min(s) AS x FROM pairs GROUP BY query_id) SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, max(score) AS score FROM k GROUP BY ALL) QUALIFY rank <= 10""")
def a16_keep_best(t: Tables) -> DataFrame:
    """Of documents that several runs give, the best score; then ranked anew."""
    x = run(t, 10).unionByName(run(t, 10, 1)).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where("rank <= 10")


@query(f"{BAGS}, {CENTRES}, w AS (SELECT query_id, c FROM bl) SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(c, v), 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(c, v), 5) DESC, vec_id) AS rank FROM w, e WHERE query_id <> vec_id QUALIFY rank <= 10")
def r20_bag_search(t: Tables) -> DataFrame:
    """Search by the bag's centroid in place of the query."""
    return D.search(described(t).select("query_id", F.col("total").alias("v")), vectors(t), 10, digits=5)


