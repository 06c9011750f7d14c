"""Queries by operator id, each with its DuckDB twin. Floating-point results are rounded alike on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions import temporal, text
from ferrule.operators import chunks, percentiles, search, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Tables = Callable[[str], DataFrame]

DAY, LAST = "1998-06-01", "2010-06-01"
_SPARK_DOC = "date_add(date'2000-01-01', cast(doc_id % 8000 as int))"
_SQL_DOC = "DATE '2000-01-01' + CAST(doc_id % 8000 AS INTEGER)"


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def dated(t: Tables) -> DataFrame:
    """Orders as dated documents: from the order's day to the last shipment (open orders have no end); finished ones are judgments, the others statutes."""
    last = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.max("l_shipdate")).alias("till"))
    kind, end = F.when(F.col("o_orderstatus") == "F", "judgment").otherwise("statute"), F.when(F.col("o_orderstatus") != "O", F.col("till"))
    return t("orders").join(last, "o_orderkey", "left").select(F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("start"), end.alias("end_"), kind.alias("kind"))


_DATED = """(SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS start, CASE WHEN o_orderstatus <> 'O' THEN till END AS end_, CASE WHEN o_orderstatus = 'F' THEN 'judgment' ELSE 'statute' END AS kind
    FROM orders LEFT JOIN (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS till FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""


def _day() -> Column:
    return F.lit(DAY).cast("date")


# -- sources, sinks, table maintenance


@query("src01_scan", "SELECT doc_id, lang, source FROM documents")
def _(t): return t("documents").select("doc_id", "lang", "source")


@query("src09_html_title", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS page_lang FROM pages")
def _(t): return t("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("page_lang"))


@query("src10_upsert", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, 'NEW' FROM customer WHERE c_custkey % 5 = 0")
def _(t):
    c = t("customer").select("c_custkey", "c_mktsegment")
    return tables.upsert(c, c.where("c_custkey % 5 = 0").withColumn("c_mktsegment", F.lit("NEW")), ["c_custkey"])


@query("src11_insert_absent", "SELECT c_custkey FROM customer")
def _(t):
    c = t("customer").select("c_custkey")
    return tables.insert_absent(c.where("c_custkey % 2 = 0"), c, ["c_custkey"])


@query("src12_retention", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def _(t):
    last = t("events").agg(F.max("ts").alias("last"))
    return t("events").join(F.broadcast(last)).where(F.expr("ts >= last - interval 10 days")).select("event_id")


@query("src13_anonymise", "SELECT event_id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS user_id, CASE WHEN user_id % 10 = 0 THEN '[ANONYMIZED]' ELSE props END AS props FROM events")
def _(t):
    hit = F.col("user_id") % 10 == 0
    return t("events").select("event_id", F.when(~hit, F.col("user_id")).alias("user_id"), F.when(hit, "[ANONYMIZED]").otherwise(F.col("props")).alias("props"))


@query("src16_changes", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'INSERT' WHEN c_custkey % 7 = 1 THEN 'DELETE' ELSE 'UPDATE' END AS action FROM customer WHERE c_custkey % 7 < 3")
def _(t):
    c = t("customer").select("c_custkey", "c_name")
    new = c.where("c_custkey % 7 <> 1").withColumn("c_name", F.when(F.col("c_custkey") % 7 == 2, "x").otherwise(F.col("c_name")))
    return tables.changes(c.where("c_custkey % 7 <> 0"), new, "c_custkey", ["c_name"])


# -- filters


@query("fil02_valid_on", f"SELECT doc_id FROM {_DATED} WHERE (start IS NULL OR start <= DATE '{DAY}') AND (end_ IS NULL OR end_ > DATE '{DAY}')")
def _(t): return dated(t).where(temporal.valid_on(F.col("start"), F.col("end_"), _day())).select("doc_id")


@query("fil03_decided_known", f"SELECT doc_id FROM {_DATED} WHERE end_ IS NOT NULL AND end_ <= DATE '{DAY}'")
def _(t): return dated(t).where(temporal.decided_by(F.col("end_"), _day(), False)).select("doc_id")


@query("fil04_decided_or_unknown", f"SELECT doc_id FROM {_DATED} WHERE end_ IS NULL OR end_ <= DATE '{DAY}'")
def _(t): return dated(t).where(temporal.decided_by(F.col("end_"), _day(), True)).select("doc_id")


@query("fil07_typed_validity", f"SELECT doc_id, CASE kind WHEN 'statute' THEN start <= DATE '{DAY}' AND (end_ IS NULL OR end_ > DATE '{DAY}') ELSE start <= DATE '{DAY}' END AS ok FROM {_DATED}")
def _(t): return dated(t).select("doc_id", temporal.typed_validity(F.col("kind"), F.col("start"), F.col("end_"), F.col("start"), _day()).alias("ok"))


@query("fil09_prefix", "SELECT p_partkey FROM part WHERE p_name ILIKE 'S%'")
def _(t): return t("part").where(F.col("p_name").ilike("S%")).select("p_partkey")


@query("fil11_in_sorted", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(t): return t("orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("fil13_floor_by_type", "SELECT event_id FROM events WHERE value >= CASE event_type WHEN 'click' THEN 45 WHEN 'view' THEN 47 ELSE 50 END")
def _(t): return t("events").where(F.col("value") >= F.when(F.col("event_type") == "click", 45).when(F.col("event_type") == "view", 47).otherwise(50)).select("event_id")


@query("fil19_contains", "SELECT doc_id FROM documents WHERE text LIKE '%idiot%' OR text LIKE '%password%'")
def _(t): return t("documents").where(F.col("text").contains("idiot") | F.col("text").contains("password")).select("doc_id")


@query("fil20_snippet", "SELECT doc_id, substring(text, 1, 400) AS snippet FROM documents")
def _(t): return t("documents").select("doc_id", F.substring("text", 1, 400).alias("snippet"))


@query("fil22_fill_blank", "SELECT event_id, coalesce(nullif(props, ''), event_type) AS label FROM events")
def _(t): return t("events").select("event_id", F.coalesce(F.nullif("props", F.lit("")), "event_type").alias("label"))


# -- joins


@query("joi01_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t): return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("joi03_left_group", "SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(t):
    o = t("orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.sum("o_totalprice").alias("total"))
    return t("customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), r(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("joi04_full_outer_fusion", "SELECT coalesce(a.user_id, b.user_id) AS user_id, round(0.7 * coalesce(a.s, 0) + 0.3 * coalesce(b.s, 0), 4) AS score FROM (SELECT user_id, max(value) s FROM events WHERE event_type = 'click' GROUP BY 1) a FULL JOIN (SELECT user_id, max(value) s FROM events WHERE event_type = 'view' GROUP BY 1) b ON a.user_id = b.user_id")
def _(t):
    side = lambda k: t("events").where(F.col("event_type") == k).groupBy("user_id").agg(F.max("value").alias("score"))
    return search.fuse_scores(side("click"), side("view"), "user_id").select("user_id", r("score", 4).alias("score"))


@query("joi09_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def _(t): return t("customer").join(t("orders").where("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("joi09_anti", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def _(t): return t("documents").select("doc_id").join(t("labels").select("doc_id"), "doc_id", "left_anti")


@query("joi11_theta_pairs", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(t):
    n = t("nation").select("n_regionkey", "n_nationkey")
    return n.withColumnRenamed("n_nationkey", "x").join(n.withColumnRenamed("n_nationkey", "y"), "n_regionkey").where("x < y").select("x", "y")


@query("joi15_interval", "SELECT o.o_orderkey, c.c_custkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE CAST(o.o_orderdate AS DATE) >= DATE '1992-01-01' + CAST(c.c_custkey % 2000 AS INTEGER) AND CAST(o.o_orderdate AS DATE) < DATE '1992-01-01' + CAST(c.c_custkey % 2000 AS INTEGER) + 900")
def _(t):
    s = F.expr("date_add(date'1992-01-01', cast(c_custkey % 2000 as int))")
    spans = t("customer").select("c_custkey", F.col("c_custkey").alias("k"), s.alias("s"), F.date_add(s, 900).alias("e"))
    points = t("orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d"))
    return tables.interval_join(points, spans, "d", "s", "e", ["k"]).select("o_orderkey", "c_custkey")


@query("joi15_as_of", "SELECT a.event_id, b.value AS last_view FROM (SELECT * FROM events WHERE event_type = 'click') a ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def _(t):
    e = t("events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("last_view"))
    return tables.as_of(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "last_view").select("event_id", "last_view")


@query("joi15_open_interval", """WITH spans AS (
    SELECT o_custkey, o_orderkey, CASE WHEN lag(o_orderdate) OVER w IS NULL THEN NULL ELSE CAST(o_orderdate AS DATE) END AS s, CAST(lead(o_orderdate) OVER w AS DATE) AS e FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
    SELECT s.o_orderkey, count(*) AS shipped, sum(l_linenumber) AS line_numbers FROM lineitem JOIN orders o ON l_orderkey = o.o_orderkey JOIN spans s ON s.o_custkey = o.o_custkey
    AND (s.s IS NULL OR CAST(l_shipdate AS DATE) >= s.s) AND (s.e IS NULL OR CAST(l_shipdate AS DATE) < s.e) GROUP BY s.o_orderkey""")
def _(t):
    """What was shipped to a customer while each order was the latest: the first order's time has no beginning, the last one's no end."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    day = F.to_date("o_orderdate")
    spans = t("orders").select("o_custkey", "o_orderkey", F.when(F.lag("o_orderdate").over(w).isNotNull(), day).alias("s"), F.to_date(F.lead("o_orderdate").over(w)).alias("e"))
    points = t("lineitem").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select("o_custkey", "l_linenumber", F.to_date("l_shipdate").alias("d"))
    return tables.interval_join(points, spans, "d", "s", "e", ["o_custkey"]).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("shipped"), F.sum("l_linenumber").alias("line_numbers"))


# -- aggregations


@query("agg01_coverage", "SELECT count(*) AS total, count(*) FILTER (lang = 'en') AS en, count(DISTINCT source) AS sources, round(count(*) FILTER (lang = 'en') / greatest(1, count(*)), 6) AS coverage FROM documents")
def _(t):
    en = F.count_if(F.col("lang") == "en")
    return t("documents").agg(F.count(F.lit(1)).alias("total"), en.alias("en"), F.count_distinct("source").alias("sources"), r(en / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("coverage"))


@query("agg03_compliance", "SELECT event_type, count(*) AS n, CASE WHEN count(*) > 2000 THEN 'high' WHEN count(*) > 1000 THEN 'medium' ELSE 'low' END AS level FROM events GROUP BY 1")
def _(t):
    n = F.col("n")
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.when(n > 2000, "high").when(n > 1000, "medium").otherwise("low"))


@query("agg07_conversations", "SELECT conv_id, count(*) AS n, min(turn) AS first_turn, max(turn) AS last_turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS asked FROM conversations GROUP BY 1")
def _(t): return t("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count_if(F.col("role") == "user").alias("asked"))


@query("agg08_percentile_cont", "SELECT source, round(quantile_cont(n_chars, 0.5), 4) AS p50, round(quantile_cont(n_chars, 0.95), 4) AS p95, max(n_chars) AS hi, min(n_chars) AS lo FROM documents GROUP BY 1")
def _(t):
    docs = t("documents")
    ends = docs.groupBy("source").agg(F.max("n_chars").alias("hi"), F.min("n_chars").alias("lo"))
    return percentiles.percentiles(docs, "source", "n_chars", {"p50": 0.5, "p95": 0.95}).select("source", r(F.col("p50"), 4).alias("p50"), r(F.col("p95"), 4).alias("p95")).join(ends.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")


@query("agg09_top_groups", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 5")
def _(t): return t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(5)


@query("agg10_distinct", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types FROM events")
def _(t): return t("events").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types"))


@query("agg13_query_stats", "SELECT event_type, count(*) AS n, round(avg(value) FILTER (value < 50), 6) AS avg_low, round(count(*) FILTER (value < 50) / count(*), 6) AS rate FROM events GROUP BY 1")
def _(t): return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.when(F.col("value") < 50, F.col("value")))).alias("avg_low"), r(F.count_if(F.col("value") < 50) / F.count(F.lit(1))).alias("rate"))


@query("agg17_percentile_floor", "SELECT event_type, list_sort(list(value))[CAST(least(floor(0.95 * count(*)), count(*) - 1) AS BIGINT) + 1] AS value FROM events GROUP BY 1")
def _(t): return tables.percentile_floor(t("events").where("value is not null"), "event_type", "value", 95)


@query("agg23_weighted_mean", "SELECT l_returnflag, CAST(trunc(sum(l_quantity * l_extendedprice) / sum(l_quantity)) AS BIGINT) AS mean FROM lineitem GROUP BY 1")
def _(t): return t("lineitem").groupBy("l_returnflag").agg((F.sum(F.col("l_quantity") * F.col("l_extendedprice")) / F.sum("l_quantity")).cast("long").alias("mean"))


@query("agg25_invoice", "SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS amount, CAST(max(o_orderdate) AS DATE) + 30 AS due FROM orders GROUP BY 1")
def _(t): return t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("amount"), F.date_add(F.max(F.to_date("o_orderdate")), 30).alias("due"))


@query("agg26_usage", "SELECT user_id, strftime(ts, '%Y-%m-%d') AS bucket, count(*) AS n FROM events GROUP BY 1, 2 UNION ALL SELECT user_id, strftime(ts, '%Y-%m-%d-%H'), count(*) FROM events GROUP BY 1, 2")
def _(t):
    e = t("events").select("user_id", F.explode(F.array(F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "yyyy-MM-dd-HH"))).alias("bucket"))
    return e.groupBy("user_id", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query("agg28_latest", "SELECT user_id, count(*) AS n, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, arg_max(value, event_id) AS latest FROM events GROUP BY 1")
def _(t): return t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), r(F.avg("value")).alias("mean"), F.max_by("value", "event_id").alias("latest"))


@query("agg31_corpus", "SELECT lang, round(avg(length(text)), 6) AS mean, min(length(text)) AS lo, max(length(text)) AS hi, round(avg(CASE WHEN contains(text, chr(10)) THEN 1.0 ELSE 0.0 END), 6) AS structured FROM documents GROUP BY 1")
def _(t): return t("documents").groupBy("lang").agg(r(F.avg(F.length("text"))).alias("mean"), F.min(F.length("text")).cast("long").alias("lo"), F.max(F.length("text")).cast("long").alias("hi"), r(F.avg(F.when(F.col("text").contains("\n"), 1.0).otherwise(0.0))).alias("structured"))


@query("agg32_markers", "SELECT m AS marker, count(*) FILTER (contains(text, m)) AS docs, round(avg((length(text) - length(replace(text, m, ''))) / length(m)), 6) AS mean FROM documents, (VALUES ('the'), ('and'), ('der')) v(m) GROUP BY 1")
def _(t):
    d = t("documents").select("text", F.explode(F.array(F.lit("the"), F.lit("and"), F.lit("der"))).alias("marker"))
    n = (F.length("text") - F.length(F.replace("text", F.col("marker"), F.lit("")))) / F.length("marker")
    return d.groupBy("marker").agg(F.count_if(F.col("text").contains(F.col("marker"))).alias("docs"), r(F.avg(n)).alias("mean"))


@query("surface_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(t): return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("surface_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(t): return t("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


# -- windows and top-k


@query("win01_rank", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events")
def _(t): return t("events").select("event_id", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")).cast("long").alias("rank"))


@query("win02_max_norm", "SELECT event_id, round(value / max(value) OVER (PARTITION BY user_id), 6) AS score FROM events")
def _(t): return t("events").select("event_id", r(F.col("value") / F.max("value").over(Window.partitionBy("user_id"))).alias("score"))


@query("win03_cap", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 3")
def _(t): return search.cap_per_group(t("documents"), "source", "n_chars", "doc_id", 3).select("doc_id")


@query("win04_first_seen", "SELECT text_hash, min(doc_id) AS doc_id FROM (SELECT sha256(text) AS text_hash, doc_id FROM documents) GROUP BY 1")
def _(t): return tables.first_seen(t("documents").select(F.sha2("text", 256).alias("text_hash"), "doc_id"), ["text_hash"], "doc_id")


@query("win05_budget", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS s FROM conversations) WHERE s <= 300")
def _(t): return tables.within_budget(t("conversations"), "conv_id", [F.desc("turn")], text.token_estimate(F.col("text")), 300).select("conv_id", "turn")


@query("win14_alert_runs", "WITH a AS (SELECT user_id, event_id, value > 50 AS hot, sum(CASE WHEN value > 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events) SELECT user_id, run, count(*) AS n FROM a WHERE hot GROUP BY 1, 2 HAVING count(*) >= 3")
def _(t): return tables.runs(t("events"), "user_id", ["ts", "event_id"], F.coalesce(F.col("value") > 50, F.lit(False))).groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query("win15_trend", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS step FROM events")
def _(t): return t("events").select("event_id", r(F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("step"))


@query("top05_page", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def _(t): return t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey")


# -- set operations


@query("set01_union_tag", "SELECT c_custkey AS k, 'c' AS tag FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier")
def _(t): return t("customer").select(F.col("c_custkey").alias("k"), F.lit("c").alias("tag")).unionByName(t("supplier").select(F.col("s_suppkey").alias("k"), F.lit("s").alias("tag")))


@query("set05_except", "SELECT doc_id AS k FROM documents EXCEPT SELECT doc_id FROM labels")
def _(t): return t("documents").select(F.col("doc_id").alias("k")).subtract(t("labels").select("doc_id"))


@query("set04_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(t): return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey"))


# -- retrieval

_Q0 = "(SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings WHERE vec_id = 0)"


def _vec0(t: Tables) -> list[float]:
    """The query vector: one row, by its id."""
    return t("embeddings").where("vec_id = 0").first().embedding


@query("rnk01_top_k", f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS sim FROM embeddings, {_Q0} ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) DESC, vec_id LIMIT 20")
def _(t): return search.nearest(t("embeddings"), _vec0(t), 20, "vec_id").select("vec_id", r("sim").alias("sim"))


@query("rnk02_normalise", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm FROM embeddings")
def _(t): return t("embeddings").select("vec_id", r(search.norm("embedding"), 4).alias("norm"))


@query("rnk06_batch_search", "WITH q AS (SELECT vec_id AS q_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0) SELECT q_id, vec_id, rank FROM (SELECT q_id, vec_id, row_number() OVER (PARTITION BY q_id ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) DESC, vec_id) AS rank FROM embeddings, q) WHERE rank <= 5")
def _(t):
    q = t("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    return search.nearest_each(t("embeddings"), q, 5).select("q_id", "vec_id", F.col("rank").cast("long").alias("rank"))


_BM25 = """(WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
    s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w), p AS (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM w),
    tf AS (SELECT doc_id, l, term, count(*) AS f FROM p WHERE term IN ('idiot', 'the', 'password') GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
    SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a))) AS score, count(*) AS matched FROM tf JOIN df USING (term), s GROUP BY doc_id)"""


def _bm25(t: Tables) -> DataFrame:
    return search.bm25(t("documents"), ["idiot", "the", "password"], "doc_id", "text")


@query("rnk08_bm25", f"SELECT doc_id, round(score, 6) AS score, matched FROM {_BM25}")
def _(t): return _bm25(t).select("doc_id", r("score").alias("score"), "matched")


@query("rnk18_hybrid", f"""WITH v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) DESC, vec_id) AS rank FROM embeddings, {_Q0} QUALIFY rank <= 50),
    k AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {_BM25} QUALIFY rank <= 50),
    f AS (SELECT coalesce(v.doc_id, k.doc_id) AS doc_id, 1.0::DOUBLE / (60 + coalesce(v.rank, 1000000)) + 1.0::DOUBLE / (60 + coalesce(k.rank, 1000000)) AS rrf FROM v FULL JOIN k ON v.doc_id = k.doc_id),
    d AS (SELECT f.doc_id, rrf, source, text FROM f JOIN documents USING (doc_id) WHERE {_SQL_DOC.replace("doc_id", "f.doc_id")} <= DATE '{LAST}'),
    c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rrf DESC, doc_id) AS nth FROM d)
    SELECT doc_id, source, round(rrf, 8) AS rrf, substring(text, 1, 100) AS snippet FROM c WHERE nth <= 3 ORDER BY c.rrf DESC, doc_id LIMIT 10""")
def flagship(t: Tables) -> DataFrame:
    """Vector and BM25 legs, rank fusion, date filter, cap for each source, top 10, text fetched last."""
    v = search.ranked(search.nearest(t("embeddings"), _vec0(t), 50, "vec_id"), "sim", "vec_id", "rank").select(F.col("vec_id").alias("doc_id"), "rank")
    top = _bm25(t).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "doc_id").limit(50)
    k = search.ranked(top, "score", "doc_id", "rank").select("doc_id", "rank")
    fused = search.fuse_ranks(v, k, "doc_id").select("doc_id", "rrf")
    docs = t("documents").where(temporal.decided_by(F.expr(_SPARK_DOC), F.lit(LAST).cast("date"), False)).select("doc_id", "source", F.substring("text", 1, 100).alias("snippet"))
    capped = search.cap_per_group(docs.join(F.broadcast(fused), "doc_id"), "source", "rrf", "doc_id", 3)
    return capped.orderBy(F.desc("rrf"), "doc_id").limit(10).select("doc_id", "source", r("rrf", 8).alias("rrf"), "snippet")


@query("rnk22_mmr", "SELECT doc_id, round(0.7 * n_chars - 0.3 * CASE WHEN row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) > 1 THEN 1 ELSE 0 END, 6) AS mmr FROM documents")
def _(t): return search.diversify(t("documents"), "source", "n_chars", "doc_id").select("doc_id", r("mmr").alias("mmr"))


# -- scalar functions


@query("str01_tokens", "SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n FROM documents")
def _(t): return t("documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n"))


@query("str04_sha256", "SELECT doc_id, sha256(text) AS h FROM documents")
def _(t): return t("documents").select("doc_id", F.sha2("text", 256).alias("h"))


@query("str05_cache_key", "SELECT doc_id, left(sha256(concat_ws('|', lang, source)), 16) AS k FROM documents")
def _(t): return t("documents").select("doc_id", text.cache_key(F.col("lang"), F.col("source")).alias("k"))


@query("str11_ocr", "SELECT doc_id, replace(replace(replace(text, 'rn', 'm'), 'cl', 'd'), 'vv', 'w') AS fixed FROM documents")
def _(t): return t("documents").select("doc_id", text.fix_ocr(F.col("text")).alias("fixed"))


@query("str22_unsafe", "SELECT page_id, regexp_matches(html, '(?i)<script|javascript:|union\\s+select|drop\\s+table|;\\s*--|\\bor\\s+1=1') AS bad FROM pages")
def _(t): return t("pages").select("page_id", text.unsafe(F.col("html")).alias("bad"))


@query("dat01_query_date", "SELECT doc_id, CAST(coalesce(try_strptime(nullif(regexp_extract(q, '([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})', 1), ''), '%d/%m/%Y'), try_strptime(nullif(regexp_extract(q, '\\b(1[89][0-9]{2}|2[0-4][0-9]{2})\\b', 1), '') || '-12-31', '%Y-%m-%d')) AS DATE) AS d FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'law on ' || (doc_id % 28 + 1) || '/' || (doc_id % 12 + 1) || '/2019' ELSE 'law in ' || (1950 + doc_id % 60) END AS q FROM documents)")
def _(t):
    q = F.expr("case when doc_id % 2 = 0 then concat('law on ', doc_id % 28 + 1, '/', doc_id % 12 + 1, '/2019') else concat('law in ', 1950 + doc_id % 60) end")
    return t("documents").select("doc_id", temporal.query_date(q).alias("d"))


@query("dat04_code", "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) >= DATE '1998-07-01' THEN 'new' ELSE 'old' END AS code FROM orders")
def _(t): return t("orders").select("o_orderkey", temporal.applicable_code(F.to_date("o_orderdate"), "1998-07-01").alias("code"))


@query("rnk20_recency", "SELECT o_orderkey, round(1 / (1 + date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') / 365.0), 6) AS recency FROM orders")
def _(t): return t("orders").select("o_orderkey", r(temporal.recency(F.to_date("o_orderdate"), F.lit("2001-08-01").cast("date"))).alias("recency"))


@query("mth02_half_even", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4, 0) AS q FROM lineitem")
def _(t): return t("lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 4, 0).alias("q"))


@query("jsn01_props", "SELECT event_id, json_extract_string(props, '$.page') AS page FROM events")
def _(t): return t("events").select("event_id", F.get_json_object("props", "$.page").alias("page"))


# -- chunkers, deduplication, verification


@query("chk11_word_windows", r"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents),
    c AS (SELECT doc_id, CAST(i // 450 AS INTEGER) AS chunk, array_to_string(w[i + 1 : i + 500], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, len(w), 450)) AS i FROM w))
    SELECT * FROM c WHERE length(text) > 50""")
def _(t): return chunks.word_windows(t("documents"), "doc_id", "text")


@query("chk03_gate", "SELECT doc_id, length(text) // 4 AS tokens, CASE WHEN length(text) // 4 < 80 THEN 'too_short' WHEN length(text) // 4 > 800 THEN 'too_long' END AS reason FROM documents")
def _(t): return chunks.token_gate(t("documents"), "text").select("doc_id", "tokens", "reason")


@query("chk16_lines", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, CAST(i AS INTEGER) AS line, CAST(coalesce(list_sum(list_transform(l[1:i], lambda x: length(x) + 1)), 0) AS INTEGER) AS start, l[i + 1] AS content FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM l)")
def _(t): return chunks.line_segments(t("documents"), "doc_id", "text")


@query("chk08_sentence_chunks")
def _(t): return chunks.sentence_chunks(t("documents"), "doc_id", "text")


@query("chk01_paragraph_windows")
def _(t): return chunks.paragraph_windows(t("documents"), "doc_id", "text")


@query("dup01_exact", "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY sha256(text)")
def _(t): return t("documents").groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).select("doc_id", "n")


@query("dup04_best", "SELECT arg_max(doc_id, n_chars * 1000000 - doc_id) AS doc_id FROM documents GROUP BY source")
def _(t): return tables.first_seen(t("documents").withColumn("o", -F.col("n_chars")), ["source"], "o", "doc_id").select("doc_id")


@query("ver02_claims", r"""SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(trim(s)) >= 10)) AS claims FROM documents""")
def _(t): return t("documents").select("doc_id", F.size(F.filter(text.sentences(F.col("text")), lambda s: F.length(F.trim(s)) >= 10)).cast("long").alias("claims"))


@query("cmp01_jaccard", r"""WITH w AS (SELECT n_nationkey AS k, list_distinct(regexp_extract_all(lower(n_name), '[a-z]')) AS s FROM nation) SELECT a.k AS x, b.k AS y, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS sim FROM w a JOIN w b ON a.k < b.k""")
def _(t):
    w = t("nation").select(F.col("n_nationkey").alias("k"), F.array_distinct(F.regexp_extract_all(F.lower("n_name"), F.lit("[a-z]"), F.lit(0))).alias("s"))
    a, b = w.toDF("x", "a"), w.toDF("y", "b")
    return a.join(F.broadcast(b), F.col("x") < F.col("y")).select("x", "y", r(text.jaccard(F.col("a"), F.col("b"))).alias("sim"))


@query("cmp01_documents")
def _(t):
    found = tables.similar_rows(t("documents").select("doc_id", F.array_sort(text.tokens(F.col("text"))).alias("s")), "doc_id", "s")
    return found.select("x", "y", r(F.col("shared") / F.col("every")).alias("sim"))


@query("joi11_document_pairs")
def _(t): return tables.similar_rows(t("documents").select("doc_id", F.array_sort(text.tokens(F.col("text"))).alias("s")), "doc_id", "s").select("x", "y", "shared")


# -- event time


@query("stm05_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t):
    from ferrule.streaming.windows import windowed_stats

    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_stats(e, "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r("total", 4).alias("total"))


@query("stm13_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def _(t): return t("events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("stm01_admit")
def _(t):
    from ferrule.streaming.windows import admit

    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return admit(e, limit=2, seconds=86_400)
