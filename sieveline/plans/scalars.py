"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lexical import content
from .registry import Tables, query

SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"SELECT DISTINCT p_name || ' (' || p_brand || ')' AS title, {SLUG.format("p_name || ' (' || p_brand || ')'")} AS slug FROM part")
def p5_slugify(t: Tables) -> DataFrame:
    title = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")"))
    return t.part.select(title.alias("title"), T.slugify(title).alias("slug")).distinct()


@query("SELECT page_id, length(x) AS n, md5(x) AS hash FROM (SELECT page_id, trim(regexp_replace(html, '<[^>]+>', '', 'g')) AS x FROM pages)")
def p6_strip_tags_whole(t: Tables) -> DataFrame:
    x = t.pages.select("page_id", T.strip_tags(F.col("html")).alias("x"))
    return x.select("page_id", F.length("x").cast("long").alias("n"), F.md5(F.col("x").cast("binary")).alias("hash"))


def decoded(c: str) -> str:
    for a, b in T.ENTITIES.items():
        c = f"replace({c}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return c


@query(f"SELECT page_id, length(x) AS n, md5(x) AS hash FROM (SELECT page_id, trim(regexp_replace(regexp_replace({decoded('html')}, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS x FROM pages)")
def p7_strip_html(t: Tables) -> DataFrame:
    x = t.pages.select("page_id", T.strip_html(F.col("html")).alias("x"))
    return x.select("page_id", F.length("x").cast("long").alias("n"), F.md5(F.col("x").cast("binary")).alias("hash"))


@query("SELECT doc_id, length(source || chr(10) || chr(10) || substr(text, 1, 2400 - length(source) - 2)) AS n, md5(source || chr(10) || chr(10) || substr(text, 1, 2400 - length(source) - 2)) AS hash FROM documents")
def p8_assemble(t: Tables) -> DataFrame:
    """Title and body within a limit (the limit is the feature)."""
    x = T.assemble(F.col("source"), F.col("text"))
    return t.documents.select("doc_id", F.length(x).cast("long").alias("n"), F.md5(x.cast("binary")).alias("hash"))


@query("SELECT doc_id, substr(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')), 1, 200) AS head FROM documents")
def p9_clip(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.clip(F.col("text"), 200).alias("head"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(x)), ' - [^,]*$', ''), '\\s*\\([^)]*\\)\\s*$', ''), '[,.;:]+$', '')) AS title FROM (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ' - ' || p_type WHEN 1 THEN ' (' || p_brand || ')' WHEN 2 THEN ', Inc.' ELSE '' END AS x FROM part)")
def p10_normalize_title(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    tail = F.when(k == 0, F.concat(F.lit(" - "), "p_type")).when(k == 1, F.concat(F.lit(" ("), F.col("p_brand"), F.lit(")"))).when(k == 2, ", Inc.").otherwise("")
    return t.part.select("p_partkey", T.normalize_title(F.concat("p_name", tail)).alias("title"))


@query("SELECT page_id, lower(trim(regexp_replace(url, '[-_./]+', ' ', 'g'))) AS tokens FROM pages")
def p11_slug_tokens(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.slug_tokens(F.col("url")).alias("tokens"))


@query("""WITH x AS (SELECT p_partkey, list_filter([trim(p_name), trim(upper(p_name)), trim(p_type), trim(CASE WHEN p_size > 25 THEN p_brand ELSE '' END), trim(lower(p_type))], lambda s: s <> '') AS l FROM part), u AS (SELECT p_partkey, l, list_transform(l, lambda s: lower(s)) AS k FROM x)
SELECT p_partkey, array_to_string(list_filter(l, lambda s, i: list_position(k, lower(s)) = i), ' — ') AS text FROM u""")
def p12_enrich(t: Tables) -> DataFrame:
    x = T.enrich(F.col("p_name"), F.upper("p_name"), F.col("p_type"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(""), F.lower("p_type"))
    return t.part.select("p_partkey", x.alias("text"))


PAY = "CASE p_partkey % 4 WHEN 0 THEN '$' || CAST(CAST(floor(p_retailprice) AS INTEGER) AS VARCHAR) || ',500 - ' || CAST(CAST(floor(p_retailprice) AS INTEGER) + 1 AS VARCHAR) || ',000' WHEN 1 THEN 'RM ' || CAST(CAST(floor(p_retailprice) AS INTEGER) AS VARCHAR) WHEN 2 THEN '€' || CAST(CAST(floor(p_retailprice) AS INTEGER) AS VARCHAR) || '.50 a month' ELSE 'negotiable' END"
AMOUNT = "TRY_CAST(replace(regexp_extract(x, '(RM|[$€£])\\s*([0-9][0-9,]*(?:\\.[0-9]+)?)(?:\\s*-\\s*(?:RM|[$€£])?\\s*([0-9][0-9,]*(?:\\.[0-9]+)?))?', {}), ',', '') AS DOUBLE)"


@query(f"WITH p AS (SELECT p_partkey, {PAY} AS x FROM part) SELECT p_partkey, {AMOUNT.format(2)} AS low, coalesce({AMOUNT.format(3)}, {AMOUNT.format(2)}) AS high, CASE regexp_extract(x, '(RM|[$€£])\\s*[0-9]', 1) WHEN '$' THEN 'USD' WHEN '€' THEN 'EUR' WHEN 'RM' THEN 'MYR' END AS currency FROM p")
def p13_salary(t: Tables) -> DataFrame:
    n, k = F.col("p_retailprice").cast("int"), F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit("$"), n, F.lit(",500 - "), n + 1, F.lit(",000"))).when(k == 1, F.concat(F.lit("RM "), n)).when(k == 2, F.concat(F.lit("€"), n, F.lit(".50 a month"))).otherwise("negotiable")
    return t.part.select("p_partkey", T.salary(text).alias("s")).select("p_partkey", "s.*")


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS x, strftime(make_timestamp(epoch_us(ts) // 1000000 * 1000000), '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def p14_tolerant_parse(t: Tables) -> DataFrame:
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    x = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("value").cast("string")).try_cast("double")
    return t.events.select("event_id", ms.alias("ms"), x.alias("x"), F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN true ELSE ts >= TIMESTAMP '2024-01-15 00:00:00' END AS kept FROM events")
def p15_recency(t: Tables) -> DataFrame:
    """A time that is missing or unreadable is kept."""
    said = F.when(F.col("event_id") % 5 == 0, F.when(F.col("event_id") % 2 == 0, "soon")).otherwise(F.col("ts").cast("string"))
    return t.events.select("event_id", T.recent(said, F.lit("2024-01-15 00:00:00").cast("timestamp")).alias("kept"))


@query("SELECT c_custkey, c_mktsegment IN ('MACHINERY', 'FURNITURE') AS remote FROM customer")
def p16_remote(t: Tables) -> DataFrame:
    place = F.when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("Berlin"), F.lit("Remote - EU"))).when(F.col("c_mktsegment") == "FURNITURE", F.array(F.lit("work from Anywhere"))).otherwise(F.array(F.lit("Paris")))
    return t.customer.select("c_custkey", T.remote(place).alias("remote"))


@query("SELECT p_partkey, p_type AS slug, p_name || ':' || p_brand AS rest FROM part")
def p17_split_id(t: Tables) -> DataFrame:
    parts = F.split(F.concat_ws(":", F.lit("src"), "p_type", "p_name", "p_brand"), ":", 3)
    return t.part.select("p_partkey", parts[1].alias("slug"), parts[2].alias("rest"))


RULES = [("widget|gear", "machine"), ("ring|bolt", "fastener"), ("^(red|blue)", "coloured")]


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(p_name, '{p}') THEN '{x}'" for p, x in RULES) + " END AS label FROM part")
def p18_rules(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.first_rule(F.col("p_name"), RULES).alias("label"))


@query("SELECT item_id, CASE WHEN n <= 12 THEN 'short' WHEN n <= 25 THEN 'medium' ELSE 'long' END AS size, has_digit FROM (SELECT item_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n, regexp_matches(text, '[0-9]') AS has_digit FROM benchmark)")
def p19_query_class(t: Tables) -> DataFrame:
    n = F.size(T.tokens(F.col("text")))
    return t.benchmark.select("item_id", F.when(n <= 12, "short").when(n <= 25, "medium").otherwise("long").alias("size"), F.col("text").rlike("[0-9]").alias("has_digit"))


PHRASES = "CASE p_partkey % 6 WHEN 0 THEN p_name || ' without ' || lower(p_type) || ' finish' WHEN 1 THEN 'best ' || p_name WHEN 2 THEN p_name || ' x200-b' WHEN 3 THEN p_name || ' heavy duty' WHEN 4 THEN 'rust-free ' || p_name ELSE p_name END"


def phrases(t: Tables) -> DataFrame:
    k, n = F.col("p_partkey") % 6, F.col("p_name")
    x = F.when(k == 0, F.concat(n, F.lit(" without "), F.lower("p_type"), F.lit(" finish"))).when(k == 1, F.concat(F.lit("best "), n)).when(k == 2, F.concat(n, F.lit(" x200-b"))).when(k == 3, F.concat(n, F.lit(" heavy duty"))).when(k == 4, F.concat(F.lit("rust-free "), n)).otherwise(n)
    return t.part.select("p_partkey", "p_type", x.alias("q"))


@query(f"WITH p AS (SELECT p_partkey, {PHRASES} AS q FROM part) SELECT p_partkey, CASE WHEN regexp_matches(q, '\\b(without|not|no|non|except)\\b') THEN 'negation' WHEN regexp_matches(q, '\\b(best|good|cheap|nice|gift|cool|top)\\b') THEN 'abstract' WHEN regexp_matches(q, '(^| )[a-z0-9-]*[0-9][a-z0-9-]*( |$)') THEN 'model_number' WHEN len(regexp_extract_all(q, '[a-z0-9]+')) >= 4 THEN 'compound_spec' ELSE 'ambiguous' END AS cause FROM p")
def p20_inversion_cause(t: Tables) -> DataFrame:
    return phrases(t).select("p_partkey", T.inversion_cause(F.col("q")).alias("cause"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN lower(p_type) WHEN 4 THEN 'rust' ELSE '' END AS negated FROM part")
def p21_negation(t: Tables) -> DataFrame:
    return phrases(t).select("p_partkey", F.array_join(T.negated(F.col("q")), ",").alias("negated"))


@query("SELECT p_partkey, p_partkey % 6 = 0 AS demoted FROM part")
def p22_negation_filter(t: Tables) -> DataFrame:
    """Whether a title holds a word that the query excludes."""
    title = F.lower(F.concat_ws(" ", "p_type", "q"))
    return phrases(t).select("p_partkey", F.exists(T.negated(F.col("q")), lambda w: F.contains(title, w) & (F.col("p_partkey") % 6 == 0)).alias("demoted"))


@query("WITH v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) SELECT a.w AS a, b.w AS b, CAST(CASE WHEN abs(length(a.w) - length(b.w)) > 3 THEN 4 ELSE least(levenshtein(a.w, b.w), 4) END AS INTEGER) AS d FROM v a JOIN v b ON substr(a.w, 1, 1) = substr(b.w, 1, 1) AND a.w < b.w")
def p24_edit_distance(t: Tables) -> DataFrame:
    v = t.part.select(F.explode(F.split("p_name", " ")).alias("a")).distinct().withColumn("k", F.substring("a", 1, 1))
    return v.join(v.withColumnRenamed("a", "b"), "k").where("a < b").select("a", "b", T.capped_distance(F.col("a"), F.col("b")).alias("d"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS brand, substr(p_name, length(split_part(p_name, ' ', 1)) + 2) AS rest FROM part")
def p28_brand_split(t: Tables) -> DataFrame:
    w = F.split(F.trim("p_name"), "\\s+", 2)
    return t.part.select("p_partkey", w[0].alias("brand"), F.coalesce(F.get(w, F.lit(1)), w[0]).alias("rest"))


@query(f"WITH x AS (SELECT item_id, {content('text')} AS k FROM benchmark), b AS (SELECT item_id, unnest(list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])) AS g FROM x) SELECT item_id, count(*) AS n, count(DISTINCT g) AS distinct_n, min(g) AS first_gram FROM b GROUP BY item_id")
def p29_bigrams(t: Tables) -> DataFrame:
    b = t.benchmark.select("item_id", F.explode(T.bigrams(T.content_tokens(F.col("text")))).alias("g"))
    return b.groupBy("item_id").agg(F.count("*").alias("n"), F.countDistinct("g").alias("distinct_n"), F.min("g").alias("first_gram"))


SAYS = "CASE turn % 5 WHEN 0 THEN 'VERDICT: exact match' WHEN 1 THEN 'Some thought.' || chr(10) || 'Verdict: related, not exact' WHEN 2 THEN 'This is irrelevant.' WHEN 3 THEN 'VERDICT:' || chr(10) || 'related' ELSE 'no idea' END"


def answers(t: Tables) -> DataFrame:
    k = F.col("turn") % 5
    x = F.when(k == 0, "VERDICT: exact match").when(k == 1, "Some thought.\nVerdict: related, not exact").when(k == 2, "This is irrelevant.").when(k == 3, "VERDICT:\nrelated").otherwise("no idea")
    return t.conversations.select("conv_id", "turn", x.alias("said"))


@query("SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'EXACT' WHEN 2 THEN 'IRRELEVANT' WHEN 3 THEN 'RELATED' ELSE 'UNCERTAIN' END AS verdict FROM conversations")
def p32_verdicts(t: Tables) -> DataFrame:
    return answers(t).select("conv_id", "turn", T.verdict(F.col("said")).alias("verdict"))


@query("SELECT conv_id, turn, CASE WHEN a = b THEN 'KEEP' WHEN a = 0 AND b > 0 THEN 'FLIP_POS' WHEN a > 0 AND b = 0 THEN 'FLIP_NEG' ELSE 'SWAP' END AS decision FROM (SELECT conv_id, turn, turn % 3 AS a, conv_id % 3 AS b FROM conversations)")
def p33_decisions(t: Tables) -> DataFrame:
    a, b = F.col("turn") % 3, F.col("conv_id") % 3
    d = F.when(a == b, "KEEP").when((a == 0) & (b > 0), "FLIP_POS").when((a > 0) & (b == 0), "FLIP_NEG").otherwise("SWAP")
    return t.conversations.select("conv_id", "turn", d.alias("decision"))


@query("SELECT conv_id, turn, round(CAST(-0.1 AS DOUBLE) * turn + CAST(0.05 AS DOUBLE) * conv_id, 6) AS odds, round((0 * exp(-1.0 * turn) + 1 * exp(-0.5) + 2 * exp(-0.25 * (conv_id % 4))) / (exp(-1.0 * turn) + exp(-0.5) + exp(-0.25 * (conv_id % 4))), 6) AS grade FROM conversations")
def p34_logprobs(t: Tables) -> DataFrame:
    one = lambda g, p: F.struct(F.lit(float(g)).alias("grade"), p.alias("logprob"))
    pairs = F.array(one(0, -1.0 * F.col("turn")), one(1, F.lit(-0.5)), one(2, -0.25 * (F.col("conv_id") % 4)))
    return t.conversations.select("conv_id", "turn", F.round(T.log_odds(-0.1 * F.col("turn"), -0.05 * F.col("conv_id")), 6).alias("odds"), F.round(T.expected_grade(pairs), 6).alias("grade"))


@query("SELECT page_id, length(x) >= 2 AND len(string_split_regex(trim(x), ' +')) <= 7 AND NOT regexp_matches(x, '[0-9]{5,}|[_/\\\\|<>{}#]|  ') AS clean FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS x FROM pages)")
def p35_suggestable(t: Tables) -> DataFrame:
    x = t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("x"))
    return x.select("page_id", T.clean_suggestion(F.col("x")).alias("clean"))


@query("SELECT DISTINCT s, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE s || 's' END AS d FROM (SELECT l_partkey * 7 % 9000 AS s FROM lineitem)")
def p36_duration(t: Tables) -> DataFrame:
    return t.lineitem.select((F.col("l_partkey") * 7 % 9000).alias("s")).distinct().select("s", T.duration(F.col("s")).alias("d"))


@query("SELECT DISTINCT l_discount AS d, 1 - l_discount / 2 AS c FROM lineitem")
def p37_l2_to_cosine(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_discount").alias("d")).distinct().select("d", T.l2_to_cosine(F.col("d")).alias("c"))


PRICES = {"click": (0.15, 0.60), "view": (2.50, 10.0), "purchase": (3.0, 15.0)}


@query("SELECT event_type, count(*) AS n, round(sum((length(props) * CASE event_type WHEN 'click' THEN .15 WHEN 'view' THEN 2.5 WHEN 'purchase' THEN 3 ELSE 0 END + 20 * CASE event_type WHEN 'click' THEN .6 WHEN 'view' THEN 10 WHEN 'purchase' THEN 15 ELSE 0 END) / 1e6), 6) AS cost FROM events GROUP BY event_type")
def p40_token_cost(t: Tables) -> DataFrame:
    """Cost by a price table; unknown models cost nothing."""
    price = lambda i: F.coalesce(F.create_map(*(x for m, p in PRICES.items() for x in (F.lit(m), F.lit(p[i]))))[F.col("event_type")], F.lit(0.0))
    cost = (F.length("props") * price(0) + 20 * price(1)) / 1e6
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(cost), 6).alias("cost"))


@query("SELECT item_id, md5('Query: ' || substr(text, 1, 120) || chr(10) || 'Answer with VERDICT.') AS prompt_hash FROM benchmark")
def p41_prompt(t: Tables) -> DataFrame:
    p = F.concat(F.lit("Query: "), F.substring("text", 1, 120), F.lit("\nAnswer with VERDICT."))
    return t.benchmark.select("item_id", F.md5(p.cast("binary")).alias("prompt_hash"))


@query(f"""WITH d AS (SELECT term, count(*) AS df FROM (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS term FROM part) GROUP BY term), q AS (SELECT DISTINCT p_name FROM part), x AS (SELECT p_name, term, round(ln(((SELECT count(*) FROM part) + 1) / (df + 1)), 6) AS idf FROM (SELECT p_name, unnest(string_split(p_name, ' ')) AS term FROM q) JOIN d USING (term))
SELECT p_name, term AS entity, trim(replace(' ' || p_name || ' ', ' ' || term || ' ', ' ')) AS category FROM x WHERE contains(p_name, ' ') QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY idf DESC, term DESC) = 1""")
def p42_entity_split(t: Tables) -> DataFrame:
    """A query's rarest word is its entity, the others are its category."""
    df = t.part.select(F.explode(F.array_distinct(F.split("p_name", " "))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = t.part.agg(F.count("*").alias("n"))
    q = t.part.select("p_name").distinct().where(F.contains("p_name", F.lit(" ")))
    x = q.select("p_name", F.explode(F.split("p_name", " ")).alias("term")).join(df, "term").crossJoin(F.broadcast(n))
    e = x.groupBy("p_name").agg(F.max_by("term", F.struct(F.round(F.log((F.col("n") + 1) / (F.col("df") + 1)), 6).alias("idf"), "term")).alias("entity"))
    return e.select("p_name", "entity", F.array_join(F.array_except(F.split("p_name", " "), F.array("entity")), " ").alias("category"))
