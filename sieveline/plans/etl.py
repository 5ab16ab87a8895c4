"""Catalog and log processing: joins, deduplication, rollups, samples, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import Tables, query


def first_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in this order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P'")
def j1_inner(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'P'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT count(*) AS n_all, count(c_custkey) AS n_known, count(*) - count(c_custkey) AS n_unknown FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON c_custkey = o_custkey")
def j1b_dropped_count(t: Tables) -> DataFrame:
    x = t.orders.join(t.customer.where("c_custkey % 3 <> 0"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return x.agg(F.count("*").alias("n_all"), F.count("c_custkey").alias("n_known"), (F.count("*") - F.count("c_custkey")).alias("n_unknown"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def j2_semi(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def j3_anti(t: Tables) -> DataFrame:
    return t.part.join(t.lineitem.where("l_quantity > 45"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey", "p_name")


@query("""WITH o AS (SELECT o_custkey, count(*) AS n_orders FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey), b AS (SELECT user_id, count(*) AS n_events FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT c_custkey, n_name, coalesce(n_orders, 0) AS n_orders, n_orders IS NOT NULL AS has_orders, n_events IS NOT NULL AS has_events FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN b ON user_id = c_custkey""")
def j4_star_presence(t: Tables) -> DataFrame:
    o = t.orders.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    b = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n_events"))
    c, at = t.customer, F.col("c_custkey")
    x = c.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(o, at == F.col("o_custkey"), "left").join(b, at == F.col("user_id"), "left")
    return x.select("c_custkey", "n_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.col("n_orders").isNotNull().alias("has_orders"), F.col("n_events").isNotNull().alias("has_events"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS place FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT o_orderkey, c_name, coalesce(string_agg(p_name, ' | ' ORDER BY l_linenumber, l.l_partkey), '') AS parts, count(p_name) AS n_parts FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN l ON l_orderkey = o_orderkey AND place <= 3 GROUP BY o_orderkey, c_name""")
def j5_nested_cast(t: Tables) -> DataFrame:
    """Per order the first three parts by line number, as an ordered list."""
    l = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.struct("l_linenumber", "l_partkey", "p_name").alias("x"))  # noqa: E741
    l = l.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("x.l_linenumber", "x.l_partkey"))).where("n <= 3")  # noqa: E741
    parts = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"))
    x = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(parts, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    names = F.transform(F.coalesce("x", F.array().cast(parts.schema["x"].dataType)), lambda s: s["p_name"])
    return x.select("o_orderkey", "c_name", F.array_join(names, " | ").alias("parts"), F.size(names).cast("long").alias("n_parts"))


@query("SELECT p_partkey, 'tt' || CASE WHEN length(CAST(p_partkey * 9973 AS VARCHAR)) >= 7 THEN CAST(p_partkey * 9973 AS VARCHAR) ELSE lpad(CAST(p_partkey * 9973 AS VARCHAR), 7, '0') END AS key FROM part")
def j6_padded_key(t: Tables) -> DataFrame:
    k = (F.col("p_partkey") * 9973).cast("string")
    return t.part.select("p_partkey", F.concat(F.lit("tt"), F.when(F.length(k) >= 7, k).otherwise(F.lpad(k, 7, "0"))).alias("key"))


@query("SELECT p_name, min(p_partkey) AS first_key, max(p_partkey) AS last_key, count(*) AS n FROM part GROUP BY p_name")
def j7_title_first_last(t: Tables) -> DataFrame:
    return t.part.groupBy("p_name").agg(F.min("p_partkey").alias("first_key"), F.max("p_partkey").alias("last_key"), F.count("*").alias("n"))


@query("SELECT count(*) AS n_left, count(n_nationkey) AS n_joined, count(*) = count(n_nationkey) AS kept FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def j16_checked_join(t: Tables) -> DataFrame:
    x = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return x.agg(F.count("*").alias("n_left"), F.count("n_nationkey").alias("n_joined"), (F.count("*") == F.count("n_nationkey")).alias("kept"))


@query("SELECT d.doc_id, CASE WHEN l.quality = 0 THEN 'rejected' ELSE d.source END AS label, l.quality IS NOT NULL AND l.quality = 0 AS fixed FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def j17_override(t: Tables) -> DataFrame:
    fix = t.labels.select("doc_id", F.when(F.col("quality") == 0, "rejected").alias("fix"))
    return t.documents.join(fix, "doc_id", "left").select("doc_id", F.coalesce("fix", "source").alias("label"), F.col("fix").isNotNull().alias("fixed"))


@query("SELECT doc_id, 'old' AS origin FROM labels UNION ALL SELECT doc_id, CASE WHEN n_chars < 500 THEN 'low' ELSE 'new' END FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j18_append_absent(t: Tables) -> DataFrame:
    new = t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id", F.when(F.col("n_chars") < 500, "low").otherwise("new").alias("origin"))
    return t.labels.select("doc_id", F.lit("old").alias("origin")).unionByName(new)


@query("SELECT coalesce(a.item, b.item) AS item, coalesce(b.n, a.n) AS n, CASE WHEN a.item IS NULL THEN 'insert' WHEN b.item IS NULL THEN 'keep' ELSE 'update' END AS action FROM (SELECT user_id AS item, count(*) AS n FROM events WHERE event_type = 'click' AND user_id % 3 > 0 GROUP BY 1) a FULL JOIN (SELECT user_id AS item, count(*) AS n FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0 GROUP BY 1) b ON a.item = b.item")
def j19_upsert(t: Tables) -> DataFrame:
    n = lambda kind, cond, name: t.events.where((F.col("event_type") == kind) & cond).groupBy(F.col("user_id").alias("item")).agg(F.count("*").alias(name))
    x = n("click", F.col("user_id") % 3 > 0, "a").join(n("purchase", F.col("user_id") % 2 == 0, "b"), "item", "full")
    return x.select("item", F.coalesce("b", "a").alias("n"), F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "keep").otherwise("update").alias("action"))


@query("WITH k AS (SELECT DISTINCT p_name AS key FROM part), p AS (SELECT DISTINCT substring(p_name, 1, 3) AS prefix FROM part), m AS (SELECT prefix, key, CASE WHEN starts_with(key, prefix) THEN 1 ELSE 2 END AS tier FROM p JOIN k ON starts_with(key, prefix) OR contains(key, ' ' || prefix)) SELECT prefix, key, tier FROM m QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY tier, key) <= 8")
def j20_prefix_suggest(t: Tables) -> DataFrame:
    """Completions: keys that start with the prefix, then keys with a word that does.

    Every word start of a key gives its first letters as a join key, so it is an equi-join.
    """
    k = t.part.select(F.col("p_name").alias("key")).distinct()
    p = k.select(F.substring("key", 1, 3).alias("prefix")).distinct()
    starts = k.select("key", F.posexplode(F.split("key", " ")).alias("at", "word")).select("key", "at", F.col("key").substr(F.lit(1), F.lit(3)).alias("own"), F.concat_ws(" ", F.lit(""), F.col("word")).alias("w"))
    heads = k.select("key", F.substring("key", 1, 3).alias("prefix"), F.lit(1).alias("tier"))
    rest = starts.where("at > 0").select("key", F.substr("w", F.lit(2), F.lit(3)).alias("prefix"), F.lit(2).alias("tier"))
    m = heads.unionByName(rest).join(p, "prefix").groupBy("prefix", "key").agg(F.min("tier").alias("tier"))
    return m.withColumn("n", F.row_number().over(Window.partitionBy("prefix").orderBy("tier", "key"))).where("n <= 8").drop("n")


@query("SELECT item_id, doc_id FROM (SELECT item_id, doc_id FROM benchmark, documents WHERE doc_id % 50 = item_id % 50) p WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = p.doc_id)")
def j20b_unjudged_pairs(t: Tables) -> DataFrame:
    p = t.documents.select("doc_id", (F.col("doc_id") % 50).alias("r")).join(t.benchmark.select("item_id", (F.col("item_id") % 50).alias("r")), "r")
    return p.join(t.labels, "doc_id", "left_anti").select("item_id", "doc_id")


@query("SELECT source, n, k FROM (SELECT source, lang AS k, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS place FROM documents GROUP BY source, lang) WHERE place <= 3")
def a11_topn_per_group(t: Tables) -> DataFrame:
    x = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    return x.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "lang"))).where("place <= 3").select("source", "n", F.col("lang").alias("k"))


@query("SELECT c_nationkey, c_mktsegment AS mode, n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1")
def a12_mode(t: Tables) -> DataFrame:
    x = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return first_by(x, ["c_nationkey"], [F.desc("n"), "c_mktsegment"]).select("c_nationkey", F.col("c_mktsegment").alias("mode"), "n")


@query("SELECT source, doc_id, length(text) AS n FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE WHEN length(text) BETWEEN 300 AND 1500 THEN 0 ELSE 1 END, length(text) DESC, doc_id) = 1")
def a13_best_sample(t: Tables) -> DataFrame:
    """A text of a good length if there is one, the longest of those; else the longest. No text is moved."""
    x = t.documents.select("source", "doc_id", F.length("text").cast("long").alias("n"))
    best = F.max_by(F.struct("doc_id", "n"), F.struct(F.col("n").between(300, 1500), "n", -F.col("doc_id"))).alias("b")
    return x.groupBy("source").agg(best).select("source", "b.doc_id", "b.n")


@query("WITH n AS (SELECT p_name, count(*) AS n FROM part GROUP BY p_name), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, p_name) AS place FROM n) SELECT k, round(sum(CASE WHEN place <= k THEN n ELSE 0 END) / sum(n), 6) AS covered FROM r, (VALUES (1), (10), (30)) v(k) GROUP BY k")
def a14_coverage(t: Tables) -> DataFrame:
    n = t.part.groupBy("p_name").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    top = n.orderBy(F.desc("n"), "p_name").limit(30).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "p_name")))
    x = top.select("n", "place", F.explode(F.array(*map(F.lit, (1, 10, 30)))).alias("k")).where("place <= k").groupBy("k").agg(F.sum("n").alias("n"))
    return x.crossJoin(F.broadcast(total)).select("k", F.round(F.col("n") / F.col("total"), 6).alias("covered"))


@query("SELECT p_partkey, p_name, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_brand), lower(p_name) ORDER BY p_partkey) = 1")
def a15_first_wins(t: Tables) -> DataFrame:
    return first_by(t.part.select("p_partkey", "p_name", "p_brand"), [F.lower("p_brand"), F.lower("p_name")], ["p_partkey"])


@query("WITH u AS (SELECT 0 AS tier, p_name AS title, p_partkey AS id FROM part WHERE p_size < 10 UNION ALL SELECT 1, p_name, p_partkey FROM part WHERE p_size >= 10) SELECT title, id, tier FROM u QUALIFY row_number() OVER (PARTITION BY title ORDER BY tier, id) = 1")
def a17_priority_dedup(t: Tables) -> DataFrame:
    x = t.part.select(F.when(F.col("p_size") < 10, 0).otherwise(1).alias("tier"), F.col("p_name").alias("title"), F.col("p_partkey").alias("id"))
    return first_by(x, ["title"], ["tier", "id"])


@query("SELECT event_type AS provider, user_id % 5 AS model, count(*) AS n, round(sum(value), 2) AS cost FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 5), ())")
def a18_rollup_sets(t: Tables) -> DataFrame:
    x = t.events.select(F.col("event_type").alias("provider"), (F.col("user_id") % 5).alias("model"), "value")
    return x.groupingSets([["provider"], ["model"], []], "provider", "model").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("cost"))


@query("SELECT source, count(*) AS kept, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS resolved FROM documents GROUP BY source")
def a19_source_stats(t: Tables) -> DataFrame:
    x = t.documents.select("source", "doc_id").join(t.labels.select("doc_id", F.lit(1).alias("y")).distinct(), "doc_id", "left")
    return x.groupBy("source").agg(F.count("*").alias("kept"), F.count("y").alias("resolved"))


@query("SELECT round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem")
def a20_quantiles(t: Tables) -> DataFrame:
    return t.lineitem.agg(*(F.round(F.percentile("l_extendedprice", p), 4).alias(f"p{int(100 * p)}") for p in (0.1, 0.25, 0.5, 0.75, 0.9)))


@query("SELECT event_type, round(median(value), 4) AS median, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS sd FROM events GROUP BY event_type")
def a21_median_mean_std(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(F.median("value"), 4).alias("median"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("sd"))


@query("WITH n AS (SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY ALL) SELECT p_name, count(*) AS brands, round(max(n) / sum(n), 6) AS top_share, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY p_name")
def a24_brand_diversity(t: Tables) -> DataFrame:
    n = t.part.groupBy("p_name", "p_brand").agg(F.count("*").alias("n"))
    return n.groupBy("p_name").agg(F.count("*").alias("brands"), F.round(F.max("n") / F.sum("n"), 6).alias("top_share"), F.sum("n").alias("n"))


@query("SELECT quality, toxic, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 6) AS share FROM labels GROUP BY quality, toxic")
def a25_confusion(t: Tables) -> DataFrame:
    n = t.labels.groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("quality")), 6))


def canonical(c: DataFrame) -> DataFrame:
    """Of each component the preferred key: even ones first, then the shortest, then by number."""
    c = c.withColumn("k", F.concat(F.lit("key "), F.col("node").cast("string")))
    return c.groupBy("root").agg(F.count("*").alias("n"), F.min_by("k", F.struct(F.col("node") % 2, F.length("k"), "node")).alias("canonical"))


PART_ROOTS = "WITH RECURSIVE ed AS (SELECT DISTINCT p_partkey AS a, p_partkey * 7 + 3 AS b FROM part), s AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), r(node, seen) AS (SELECT a, a FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.seen), c AS (SELECT node, min(least(node, seen)) AS root FROM r GROUP BY node)"


@query(f"{PART_ROOTS} SELECT node, root FROM c")
def a26_part_components(t: Tables) -> DataFrame:
    """Connected components over whole numbers of all parts."""
    from ..operators.components import components

    return components(t.part.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") * 7 + 3).alias("b")))


@query(f"{PART_ROOTS}, k AS (SELECT root, node, 'key ' || CAST(node AS VARCHAR) AS k FROM c) SELECT root, count(*) AS n, first(k ORDER BY node % 2, length(k), node) AS canonical FROM k GROUP BY root")
def a27_part_canonical(t: Tables) -> DataFrame:
    return canonical(a26_part_components(t))


@query("SELECT count(DISTINCT text) AS texts, count(DISTINCT source) AS sources, count(*) AS n FROM documents")
def a28_distinct(t: Tables) -> DataFrame:
    """Exact distinct counts; texts are compared by 128 bits of hash so that they need not travel."""
    return t.documents.agg(F.countDistinct(F.md5(F.col("text").cast("binary"))).alias("texts"), F.countDistinct("source").alias("sources"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
def o1_global_topk(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(50)


HASH = "CAST(('0x' || substr(md5(CAST({} AS VARCHAR)), 1, 8)) AS BIGINT)"


def number(c: str) -> Column:
    """The first 32 bits of a value's MD5."""
    return F.conv(F.substring(F.md5(F.col(c).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


@query(f"SELECT p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY {HASH.format('p_partkey')}, p_partkey) <= 20")
def o3_stratified(t: Tables) -> DataFrame:
    """A sample of the same size from each class (the sample is the feature)."""
    x = t.part.withColumn("n", F.row_number().over(Window.partitionBy("p_type").orderBy(number("p_partkey"), "p_partkey")))
    return x.where("n <= 20").select("p_type", "p_partkey")


@query(f"SELECT DISTINCT p_name FROM part WHERE {HASH.format('p_name')} % 100 < 20")
def o4_bernoulli(t: Tables) -> DataFrame:
    """A fifth of the distinct titles by hash (the sample is the feature)."""
    return t.part.select("p_name").distinct().where(number("p_name") % 100 < 20)


@query(f"SELECT c_custkey FROM customer ORDER BY {HASH.format('c_custkey')}, c_custkey LIMIT 100")
def o5_shuffle_limit(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").orderBy(number("c_custkey"), "c_custkey").limit(100)


@query(f"SELECT c_custkey, CASE WHEN {HASH.format('c_custkey')} % 1000 < 800 THEN 'train' ELSE 'eval' END AS part FROM customer")
def o6_hash_split(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.when(number("c_custkey") % 1000 < 800, "train").otherwise("eval").alias("part"))


@query("WITH g AS (SELECT l_suppkey AS query_id, l_partkey AS doc_id, CAST(max(l_quantity) AS BIGINT) % 4 AS grade FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, grade ORDER BY doc_id) AS turn FROM g) SELECT query_id, doc_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY turn, grade DESC) AS place FROM r QUALIFY place <= 10")
def o7_grade_cap(t: Tables) -> DataFrame:
    """Candidates by turns over the grades, up to a cap (the cap is the feature)."""
    g = t.lineitem.groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("doc_id")).agg((F.max("l_quantity").cast("long") % 4).alias("grade"))
    r = g.withColumn("turn", F.row_number().over(Window.partitionBy("query_id", "grade").orderBy("doc_id")))
    return r.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("turn", F.desc("grade")))).where("place <= 10").drop("turn")


@query("SELECT o_orderpriority, o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 AS avg_rank FROM orders WHERE o_orderstatus = 'P'")
def w4_avg_rank(t: Tables) -> DataFrame:
    by = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"))
    ties = F.count("*").over(Window.partitionBy("o_orderpriority", "o_totalprice"))
    return t.orders.where("o_orderstatus = 'P'").select("o_orderpriority", "o_orderkey", (F.rank().over(by) + (ties - 1) / 2.0).alias("avg_rank"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN count(*) OVER (PARTITION BY l_orderkey) > 1 THEN round(1 - (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) - 1) / (count(*) OVER (PARTITION BY l_orderkey) - 1), 6) ELSE 1 END AS r FROM lineitem")
def w5_norm_rank(t: Tables) -> DataFrame:
    own = Window.partitionBy("l_orderkey")
    n = F.count("*").over(own)
    place = F.row_number().over(own.orderBy(F.desc("l_extendedprice"), "l_partkey", "l_linenumber"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.when(n > 1, F.round(1 - (place - 1) / (n - 1), 6)).otherwise(F.lit(1.0)).alias("r"))


@query("SELECT user_id, round(max(CASE WHEN k = 1 THEN value END) - max(CASE WHEN k = 2 THEN value END), 4) AS gap, round(max(CASE WHEN k = 1 THEN value END) - avg(value), 4) AS above, round(stddev_pop(value), 4) AS sd FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) GROUP BY user_id")
def w8_score_gaps(t: Tables) -> DataFrame:
    x = t.events.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")))
    top, second = (F.max(F.when(F.col("k") == i, F.col("value"))) for i in (1, 2))
    return x.groupBy("user_id").agg(F.round(top - second, 4).alias("gap"), F.round(top - F.avg("value"), 4).alias("above"), F.round(F.stddev_pop("value"), 4).alias("sd"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) = 1")
def w2_top1_per_group(t: Tables) -> DataFrame:
    return first_by(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), ["l_orderkey"], [F.desc("l_extendedprice"), "l_partkey", "l_linenumber"])


@query("WITH f AS (SELECT l_orderkey, l_partkey, l_extendedprice, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_extendedprice DESC, l_linenumber) = 1) SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS place FROM f")
def w10_first_seen(t: Tables) -> DataFrame:
    x = first_by(t.lineitem, ["l_orderkey", "l_partkey"], [F.desc("l_extendedprice"), "l_linenumber"])
    return x.select("l_orderkey", "l_partkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey")).alias("place"))


@query("SELECT c_mktsegment, c_custkey, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) - 1) * 10 // count(*) OVER (PARTITION BY c_mktsegment) AS INTEGER) AS decile FROM customer")
def w11_deciles(t: Tables) -> DataFrame:
    own = Window.partitionBy("c_mktsegment")
    place = F.row_number().over(own.orderBy("c_acctbal", "c_custkey")) - 1
    return t.customer.select("c_mktsegment", "c_custkey", F.floor(place * 10 / F.count("*").over(own)).cast("int").alias("decile"))


@query("SELECT i, round(q, 4) AS x FROM (SELECT unnest(range(0, 21)) AS i, unnest(quantile_cont(o_totalprice, [x / 20.0 for x in range(0, 21)])) AS q FROM orders)")
def w12_quantile_grid(t: Tables) -> DataFrame:
    q = t.orders.agg(F.percentile("o_totalprice", [i / 20 for i in range(21)]).alias("q"))
    return q.select(F.posexplode("q").alias("i", "x")).select(F.col("i").cast("long").alias("i"), F.round("x", 4).alias("x"))


@query(f"SELECT c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY {HASH.format('c_custkey')}, c_custkey) - 1) % 5 AS fold FROM customer")
def w13_folds(t: Tables) -> DataFrame:
    """Folds dealt by hash order within each stratum."""
    own = Window.partitionBy("c_nationkey").orderBy(number("c_custkey"), "c_custkey")
    return t.customer.select("c_custkey", F.pmod(F.row_number().over(own) - 1, F.lit(5)).cast("long").alias("fold"))


@query("SELECT (SELECT count(*) FROM part) AS n_left, (SELECT count(DISTINCT p_partkey) FROM part) AS n_keys, (SELECT count(*) FROM part) = (SELECT count(DISTINCT p_partkey) FROM part) AS aligned")
def dq1_alignment(t: Tables) -> DataFrame:
    return t.part.agg(F.count("*").alias("n_left"), F.countDistinct("p_partkey").alias("n_keys"), (F.count("*") == F.countDistinct("p_partkey")).alias("aligned"))


@query(f"SELECT count(*) FILTER (WHERE {HASH.format('c_custkey')} % 1000 < 800) AS train, count(*) FILTER (WHERE {HASH.format('c_custkey')} % 1000 >= 800) AS eval, 0 AS both FROM customer")
def dq8_split_disjoint(t: Tables) -> DataFrame:
    s = o6_hash_split(t)
    a, b = (s.where(F.col("part") == p).select("c_custkey") for p in ("train", "eval"))
    both = a.intersect(b).agg(F.count("*").cast("int").alias("both"))
    return s.agg(F.count_if(F.col("part") == "train").alias("train"), F.count_if(F.col("part") == "eval").alias("eval")).crossJoin(F.broadcast(both))


@query("WITH q AS (SELECT DISTINCT lower(p_type) || ' ' || b AS q FROM part, (SELECT DISTINCT split_part(p_name, ' ', 2) AS b FROM part)) SELECT q FROM q WHERE q NOT IN (SELECT p_name FROM part)")
def p38_templates(t: Tables) -> DataFrame:
    """Queries from a template of two small dimensions, without those that exist."""
    a = t.part.select(F.lower("p_type").alias("a")).distinct()
    b = t.part.select(F.element_at(F.split("p_name", " "), 2).alias("b")).distinct()
    q = a.join(F.broadcast(b)).select(F.concat_ws(" ", "a", "b").alias("q")).distinct()
    return q.join(t.part, F.col("q") == F.col("p_name"), "left_anti")
