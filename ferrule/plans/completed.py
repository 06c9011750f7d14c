"""Queries that follow their rule in full beside smaller ones: reports over a range or a trailing window, budgets with all their bounds, JSON both ways."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ferrule.functions import text
from ferrule.operators import percentiles, search, tables
from ferrule.plans.fuller import ORACLE_SQL, QUERIES, query, r  # noqa: F401  what is registered here joins the others

# -- reports

_FROM, _TO = "2024-01-08", "2024-01-22"


@query("agg03_security_ratio", f"""WITH c AS (SELECT CASE event_type WHEN 'error' THEN 'security' WHEN 'signup' THEN 'authentication' ELSE 'data_access' END AS category, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{_FROM}' AND ts < TIMESTAMP '{_TO}' GROUP BY 1),
    s AS (SELECT *, sum(n) OVER () AS total, sum(n) FILTER (category = 'security') OVER () / sum(n) OVER () AS ratio FROM c)
    SELECT category, n, CAST(total AS BIGINT) AS total, round(ratio, 6) AS ratio, CASE WHEN ratio > 0.1 THEN 'needs attention' WHEN ratio > 0.05 THEN 'watch' ELSE 'compliant' END AS level FROM s""")
def _(t):
    """Events by category in a range of days, with the share of security events and what follows from it."""
    category = F.when(F.col("event_type") == "error", "security").when(F.col("event_type") == "signup", "authentication").otherwise("data_access")
    c = t("events").where(f"ts >= '{_FROM}' and ts < '{_TO}'").groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("total"), (F.sum(F.when(F.col("category") == "security", F.col("n"))) / F.sum("n")).alias("ratio"))
    level = F.when(F.col("ratio") > 0.1, "needs attention").when(F.col("ratio") > 0.05, "watch").otherwise("compliant")
    return c.join(F.broadcast(total)).select("category", "n", "total", r("ratio").alias("ratio"), level.alias("level"))


@query("agg07_durations", "SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (event_type = 'click') AS asked, count(*) FILTER (event_type = 'view') AS answered, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0::DOUBLE, 4) AS minutes FROM events GROUP BY user_id")
def _(t):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(F.col("event_type") == "click").alias("asked"), F.count_if(F.col("event_type") == "view").alias("answered"), r((F.max(at) - F.min(at)) / 60_000_000.0, 4).alias("minutes"))


@query("agg11_filtered", "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS cheap, count(*) FILTER (WHERE l_linestatus = 'O' AND l_quantity < 10) AS small_open, round(sum(l_quantity) FILTER (WHERE l_tax = 0), 2) AS untaxed FROM lineitem GROUP BY l_returnflag")
def _(t): return t("lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") > 0.05).alias("cheap"), F.count_if((F.col("l_linestatus") == "O") & (F.col("l_quantity") < 10)).alias("small_open"), r(F.sum(F.when(F.col("l_tax") == 0, F.col("l_quantity"))), 2).alias("untaxed"))


_WINDOW = "(SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY)"


@query("agg13_trailing_stats", f"""WITH w AS {_WINDOW}, t AS (SELECT count(*) AS n, count(*) FILTER (event_type <> 'error') AS good, round(avg(value) FILTER (event_type <> 'error'), 6) AS mean_ms, round(quantile_cont(value, 0.95) FILTER (event_type <> 'error'), 6) AS p95, round(quantile_cont(value, 0.99) FILTER (event_type <> 'error'), 6) AS p99 FROM w)
    SELECT event_type AS mode, count(*) AS in_mode, any_value(n) AS n, round(any_value(good) / any_value(n), 6) AS success_rate, any_value(mean_ms) AS mean_ms, any_value(p95) AS p95, any_value(p99) AS p99, round(any_value(n) / 2880.0::DOUBLE, 6) AS per_minute FROM w, t GROUP BY event_type""")
def _(t):
    """Of the last two days: totals, success rate, times of rows without errors with exact percentiles, rate a minute, and a row for each mode with its number."""
    last = t("events").agg(F.max("ts").alias("last"))
    w = t("events").join(F.broadcast(last)).where("ts >= last - interval 2 days").drop("last")
    good = F.col("event_type") != "error"
    total = w.agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("good"), r(F.avg(F.when(good, F.col("value")))).alias("mean_ms"))
    shares = percentiles.percentiles(w.where(good).withColumn("all", F.lit(1)), "all", "value", {"p95": 0.95, "p99": 0.99}).select(r("p95").alias("p95"), r("p99").alias("p99"))
    modes = w.groupBy(F.col("event_type").alias("mode")).agg(F.count(F.lit(1)).alias("in_mode"))
    return modes.join(F.broadcast(total)).join(F.broadcast(shares)).select("mode", "in_mode", "n", r(F.col("good") / F.col("n")).alias("success_rate"), "mean_ms", "p95", "p99", r(F.col("n") / 2880.0).alias("per_minute"))


@query("agg15_top_errors", "SELECT json_extract_string(props, '$.k') AS error, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, error LIMIT 5")
def _(t): return t("events").where("event_type = 'error'").groupBy(F.get_json_object("props", "$.k").alias("error")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error").limit(5)


@query("agg18_interpolated", "SELECT user_id, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events WHERE value IS NOT NULL GROUP BY user_id")
def _(t): return percentiles.percentiles(t("events").where("value is not null"), "user_id", "value", {"p50": 0.5, "p90": 0.9}).select("user_id", r("p50").alias("p50"), r("p90").alias("p90"))


_MARKERS = ["the", "que", "und", "[0-9]+", "license", "[.]"]


@query("agg32_markers_found", f"""WITH m AS (SELECT unnest({_MARKERS}) AS marker), c AS (SELECT marker, len(regexp_extract_all(lower(text), marker)) AS k FROM documents, m)
    SELECT marker, round(count(*) FILTER (k > 0) / count(*), 6) AS share, round(avg(k), 6) AS occurrences, count(*) FILTER (k > 0) / count(*) > 0.5 AS often FROM c GROUP BY marker""")
def _(t):
    """Of each marker the share of documents that have it and its mean number: all are counted in one pass, then turned into rows."""
    k = lambda m: F.regexp_count(F.lower("text"), F.lit(m))
    counts = t("documents").select(*[k(m).alias(f"k{i}") for i, m in enumerate(_MARKERS)])
    one = counts.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"k{i}") > 0).alias(f"with{i}") for i in range(len(_MARKERS))], *[F.avg(f"k{i}").alias(f"mean{i}") for i in range(len(_MARKERS))])
    rows = F.inline(F.array(*[F.struct(F.lit(m).alias("marker"), (F.col(f"with{i}") / F.col("n")).alias("s"), F.col(f"mean{i}").alias("o")) for i, m in enumerate(_MARKERS)]))
    return one.select(rows).select("marker", r("s").alias("share"), r("o").alias("occurrences"), (F.col("s") > 0.5).alias("often"))


# -- windows and budgets


@query("win05_last_twenty", "WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations QUALIFY k <= 20) SELECT conv_id, turn FROM (SELECT *, sum(length(coalesce(text, '')) // 4) OVER (PARTITION BY conv_id ORDER BY k) AS s FROM l) WHERE s <= 300")
def _(t):
    """Of a conversation's last 20 messages those that a budget of 300 tokens holds, newest first."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return tables.within_budget(t("conversations").withColumn("k", nth).where("k <= 20"), "conv_id", [F.col("k")], F.expr("length(coalesce(text, '')) div 4"), 300).select("conv_id", "turn")


_PAIRS = "(SELECT conv_id, turn, lead(role) OVER w = 'assistant' AS whole, text AS query, lead(text) OVER w AS answer, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"


@query("win06_exchanges", f"""WITH p AS (SELECT conv_id, turn, length(coalesce(query, '')) // 4 AS q, CASE WHEN whole THEN length(coalesce(answer, '')) // 4 ELSE 0 END AS a FROM {_PAIRS} WHERE role = 'user'),
    s AS (SELECT *, sum(q + a) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS running FROM p)
    SELECT conv_id, count(*) AS exchanges, count(*) FILTER (running <= 250) AS shown, CAST(coalesce(sum(q + a) FILTER (running <= 250), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(q) FILTER (running > 250), 0) AS BIGINT) AS summarised FROM s GROUP BY conv_id""")
def _(t):
    """Questions with their answers, newest first: how many a budget of 250 tokens shows, and what is left to sum up."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    size = lambda c: F.expr(f"length(coalesce({c}, '')) div 4")
    both = t("conversations").withColumns({"next": F.lead("role").over(w), "answer": F.lead("text").over(w)}).where("role = 'user'")
    p = both.select("conv_id", "turn", size("text").alias("q"), F.when(F.col("next") == "assistant", size("answer")).otherwise(0).alias("a"))
    s = p.withColumn("shown", F.sum(F.col("q") + F.col("a")).over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))) <= 250)
    part = lambda c, when: F.coalesce(F.sum(F.when(when, c)), F.lit(0))
    return s.groupBy("conv_id").agg(F.count(F.lit(1)).alias("exchanges"), F.count_if("shown").alias("shown"), part(F.col("q") + F.col("a"), F.col("shown")).alias("tokens"), part(F.col("q"), ~F.col("shown")).alias("summarised"))


# -- changes, JSON, vectors, texts


@query("src16_row_json", """WITH old AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_acctbal > 0), new AS (SELECT c_custkey, c_name, CASE WHEN c_acctbal > 9000 THEN 'PREMIUM' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_acctbal < 9500)
    SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'INSERT' WHEN n.c_custkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS action, CASE WHEN o.c_custkey IS NOT NULL THEN '{"c_name":"' || o.c_name || '","c_mktsegment":"' || o.c_mktsegment || '"}' END AS before, CASE WHEN n.c_custkey IS NOT NULL THEN '{"c_name":"' || n.c_name || '","c_mktsegment":"' || n.c_mktsegment || '"}' END AS after
    FROM old o FULL JOIN new n ON o.c_custkey = n.c_custkey WHERE o.c_mktsegment IS DISTINCT FROM n.c_mktsegment OR o.c_name IS DISTINCT FROM n.c_name""")
def _(t):
    """What changed between two states of a table, with each row before and after as JSON."""
    c = t("customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    new = c.where("c_acctbal < 9500").withColumn("c_mktsegment", F.when(F.col("c_acctbal") > 9000, "PREMIUM").otherwise(F.col("c_mktsegment")))
    return tables.changed_rows(c.where("c_acctbal > 0"), new, "c_custkey", ["c_name", "c_mktsegment"])


@query("jsn01_typed", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, DATE '2024-01-01' + CAST(json_extract_string(props, '$.k') AS INTEGER) AS due FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50")
def _(t):
    k = F.get_json_object("props", "$.k")
    return t("events").where(k.cast("int") >= 50).select("event_id", k.cast("long").alias("k"), F.date_add(F.lit("2024-01-01").cast("date"), k.cast("int")).alias("due"))


@query("jsn02_round_trip", "SELECT doc_id, len(w) AS n, w[1] AS first_word, w[-1] AS last_word FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents) WHERE len(w) > 0")
def _(t):
    """Lists of words encoded as JSON and decoded again."""
    js = t("documents").select("doc_id", F.to_json(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("words"))
    back = js.select("doc_id", F.from_json("words", "array<string>").alias("w")).where("size(w) > 0")
    return back.select("doc_id", F.size("w").cast("long").alias("n"), F.element_at("w", 1).alias("first_word"), F.element_at("w", -1).alias("last_word"))


@query("map01_overlay", """SELECT event_id, coalesce(CASE WHEN event_type = 'click' THEN json_extract_string(props, '$.k') END, 'low') AS level, coalesce(json_extract_string(props, '$.k'), '0') AS k FROM events""")
def _(t):
    """Defaults overlaid by what an event has: a later map's keys win."""
    own = F.from_json("props", "map<string,string>")
    level = F.when(F.col("event_type") == "click", F.create_map(F.lit("level"), F.try_element_at(own, F.lit("k")))).otherwise(F.from_json(F.lit("{}"), "map<string,string>"))
    keep = lambda m: F.map_filter(m, lambda k, v: v.isNotNull())
    base = F.create_map(F.lit("level"), F.lit("low"), F.lit("k"), F.lit("0"))
    return t("events").select("event_id", tables.overlay(base, keep(own), keep(level)).alias("m")).select("event_id", F.element_at("m", "level").alias("level"), F.element_at("m", "k").alias("k"))


@query("rnk02_unit_vectors", "WITH n AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * label) AS v FROM embeddings), s AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM n) SELECT vec_id, list_transform(v, lambda x: round(CASE WHEN norm = 0 THEN x ELSE x / norm END, 6) + 0.0) AS unit FROM s")
def _(t):
    """Vectors scaled by their label, and back to unit length; those scaled by 0 stay zero."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * F.col("label"))
    return t("embeddings").select("vec_id", scaled.alias("v"), "label").select("vec_id", F.transform(search.normalise(F.col("v")), lambda x: F.round(x, 6) + F.lit(0.0)).alias("unit"))


@query("str01_ordered", "WITH w AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)), f AS (SELECT doc_id, term, min(i) AS i FROM w GROUP BY doc_id, term) SELECT doc_id, list(term ORDER BY i)[1:20] AS tokens FROM f GROUP BY doc_id")
def _(t): return t("documents").select("doc_id", F.slice(text.tokens(F.col("text")), 1, 20).alias("tokens")).where("size(tokens) > 0")


@query("fil11_sections_sorted", "SELECT p_partkey, upper(p_type) AS section FROM part WHERE upper(p_type) IN (SELECT upper(x) FROM (SELECT unnest(['small', 'Economy', 'small']) AS x)) ORDER BY section, p_size, p_partkey LIMIT 500")
def _(t):
    """Rows of the wanted sections, given in any case and repeated, in order of section and place."""
    wanted = sorted({x.upper() for x in ["small", "Economy", "small"]})
    return t("part").withColumn("section", F.upper("p_type")).where(F.col("section").isin(wanted)).orderBy("section", "p_size", "p_partkey").limit(500).select("p_partkey", "section")


@query("dat07_keys", "SELECT strftime(ts, '%Y-%m-%d') AS day_key, strftime(ts, '%Y-%m-%d-%H') AS hour_key, count(*) AS n FROM events GROUP BY 1, 2")
def _(t): return t("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day_key"), F.date_format("ts", "yyyy-MM-dd-HH").alias("hour_key")).agg(F.count(F.lit(1)).alias("n"))


@query("mth03_truncated", "SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS whole, CAST(trunc(c_acctbal / 7) AS BIGINT) AS weekly FROM customer")
def _(t): return t("customer").select("c_custkey", F.col("c_acctbal").cast("long").alias("whole"), (F.col("c_acctbal") / 7).cast("long").alias("weekly"))
