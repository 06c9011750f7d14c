"""More queries by operator id: candidate joins, filtered searches, units of statutes, evidence for claims, rate limits and timers, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import text as T
from ferrule.functions import rules as R
from ferrule.operators import chunks, search, tables
from ferrule.plans.more import BODY, RANKED, double, scalar
from ferrule.plans.queries import _SPARK_DOC, _SQL_DOC, ORACLE_SQL, QUERIES, query, r  # noqa: F401  what is registered here joins the others
from ferrule.streaming import windows

# -- sources and status

# fixed values: file formats by extension, with their kind and whether they need character recognition
FORMATS = [("pdf", "document", True), ("docx", "document", False), ("txt", "text", False), ("html", "web", False), ("csv", "table", False), ("json", "data", False), ("png", "image", True), ("jpg", "image", True), ("tiff", "image", True), ("xml", "data", False)]
_NAMES = [*[f[0] for f in FORMATS], "exe"]
_VALUES = ", ".join(f"('{e}', '{k}', {str(o).lower()})" for e, k, o in FORMATS)


@query("src08_formats", f"SELECT page_id, kind, needs_ocr FROM pages LEFT JOIN (VALUES {_VALUES}) f(ext, kind, needs_ocr) ON ext = ({_NAMES}::VARCHAR[])[page_id % 11 + 1]")
def _(t):
    p = t("pages")
    formats = p.sparkSession.createDataFrame(FORMATS, "ext string, kind string, needs_ocr boolean")
    named = p.select("page_id", F.get(F.array(*map(F.lit, _NAMES)), (F.col("page_id") % 11).cast("int")).alias("ext"))
    return named.join(F.broadcast(formats), "ext", "left").select("page_id", "kind", "needs_ocr")  # ten rows


scalar("src14_status", "orders", "o_orderkey", {"status": "CASE WHEN o_orderstatus = 'F' AND year(o_orderdate) < 1998 THEN 'archived' WHEN o_orderstatus = 'P' THEN 'deleted' ELSE 'active' END"})
scalar("fil06_as_on", "orders", "o_orderkey", {"first_year": "CASE WHEN o_orderpriority <> '1-URGENT' THEN year(o_orderdate) END", "last_year": "CASE WHEN o_orderstatus <> 'O' THEN year(o_orderdate) + 2 END", "asked": "CASE WHEN o_totalprice > 50000.0 THEN 1998 END"}, {"valid": "asked IS NULL OR ((first_year IS NULL OR first_year <= asked) AND (last_year IS NULL OR last_year > asked))"})
scalar("fil08_dated_kinds", "documents", "doc_id", RANKED | {"year": "CASE WHEN HAS(coalesce(text, ''), '[0-9]{4}') THEN CAST(regexp_extract(text, '([0-9]{4})', 1) AS INT) END"}, {"valid": "CASE WHEN kind IN ('case_law', 'user') THEN coalesce(year <= 2012, false) ELSE coalesce(year <= 2012, true) END"})

# -- texts

_WORDS = "string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ')"


@query("str02_word_set", f"SELECT doc_id, len(list_distinct({_WORDS})) AS n_words FROM documents")
def _(t): return t("documents").select("doc_id", F.size(T.word_set(F.col("text"))).cast("long").alias("n_words"))


@query("str03_content_hash", "SELECT doc_id, sha256(regexp_replace(regexp_replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+', ' ', 'g')) AS content_hash FROM documents")
def _(t): return t("documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query("str07_tidy", f"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(b, '\\s+', ' ', 'g'), ' ([,.;:])', '\\1', 'g'), '\\b(Sec\\.|S\\.) ?([0-9])', 'Section \\2', 'g')) AS tidy FROM (SELECT doc_id, {BODY} || ' Sec. 4 , S.5 ; end' AS b FROM documents)")
def _(t): return t("documents").select("doc_id", T.tidy(F.concat(F.expr(BODY), F.lit(" Sec. 4 , S.5 ; end"))).alias("tidy"))


@query("str16_slug", "SELECT doc_id, array_to_string(list_transform((string_split_regex(trim(regexp_replace(text, '[^A-Za-z0-9 ]+', '', 'g')), ' +'))[1:3], lambda x: upper(x[1]) || lower(x[2:])), '_') AS slug FROM documents")
def _(t): return t("documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("str10_line_filter", "SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT (contains(lower(x), 'license') OR contains(lower(x), 'copyright') OR length(trim(x)) < 3)), chr(10)) AS kept FROM documents")
def _(t):
    told = lambda x: ~(F.contains(F.lower(x), F.lit("license")) | F.contains(F.lower(x), F.lit("copyright")) | (F.length(F.trim(x)) < 3))
    return t("documents").select("doc_id", F.array_join(F.filter(F.split("text", "\n"), told), "\n").alias("kept"))


scalar("str09_boilerplate", "documents", "doc_id", {"t": "concat('Page 3 of 9', chr(10), coalesce(text, ''), chr(10), 'REPORTABLE', chr(10), '----------', chr(10), 'Digitally signed by X')"}, {"cleaned": "trim(regexp_replace(regexp_replace(t, '(?im)^(page [0-9]+( of [0-9]+)?|reportable|non-reportable|digitally signed by .*|[-_=*]{5,})$', ''@G), '\\n{2,}', chr(10)@G))"})
scalar("str14_join_lines", "documents", "doc_id", {"t": "concat('HEADER 7', chr(10), coalesce(text, ''), chr(10), chr(10), 'second', chr(10), 'paragraph')"}, {"joined": "regexp_replace(regexp_replace(t, '(?m)^[A-Z ]+ [0-9]+$', ''@G), '([^\\n])\\n([^\\n])', '@1 @2'@G)"})
scalar("str19_headline", "documents", "doc_id", {"t": BODY}, {"marked": "regexp_replace(t, '(?i)\\b(court|constitution)\\b', '<b>@1</b>'@G)"})
scalar("str20_title", "documents", "doc_id", {"t": "trim(coalesce(text, ''))"}, {"title": "substring(CASE WHEN contains(lower(t), 'contract') THEN 'Contract' WHEN contains(lower(t), 'bail') THEN 'Bail' ELSE regexp_extract(t, '^((?:\\S+\\s*){0,5})', 1) END, 1, 50)"})
scalar("str24_redact", "documents", "doc_id", {"k": "CASE doc_id % 4 WHEN 0 THEN 'password' WHEN 1 THEN 'api_token' WHEN 2 THEN 'note' ELSE 'secret_key' END", "v": "coalesce(text, '')"}, {"shown": "CASE WHEN HAS(k, 'password|token|secret|key') THEN '[REDACTED]' WHEN length(v) > 1000 THEN concat(substring(v, 1, 1000), '...[TRUNCATED]') ELSE v END"})
scalar("ext08_keywords", "documents", "doc_id", {"t": BODY}, {"cases": "JOINED(regexp_extract_all(t, '[A-Z][a-z]+ vs?[.] [A-Z][a-z]+', 0), '; ')", "statutes": "JOINED(regexp_extract_all(t, '(?:Section|Article) [0-9]+', 0), '; ')", "courts": "JOINED(regexp_extract_all(lower(t), '(?:supreme|high|the) court', 0), '; ')"})
scalar("ext01_analysis", "documents", "doc_id", {"t": f"lower(concat({BODY}, CASE WHEN doc_id % 3 = 0 THEN ' theft under bail' ELSE ' murder' END))"}, {"terms": "concat(CASE WHEN contains(t, 'bail') THEN 'bail ' ELSE '' END, CASE WHEN contains(t, 'constitution') THEN 'constitution ' ELSE '' END)", "offences": "concat(CASE WHEN contains(t, 'theft') THEN 'theft ' ELSE '' END, CASE WHEN contains(t, 'murder') THEN 'murder ' ELSE '' END)", "sections": "JOINED(regexp_extract_all(t, 'section ([0-9]+)', 1), ' ')", "mentions": "LEN(regexp_extract_all(t, '[(][0-9]{4}[)]', 0))"})
scalar("ver06_citation_form", "documents", "doc_id", RANKED, {"shown": "CASE WHEN kind = 'case_law' THEN concat(substring(coalesce(text, ''), 1, 30), ' (', n_chars, ')') WHEN kind = 'statute' THEN concat('Section ', coalesce(CAST(section AS VARCHAR(20)), '?'), ', IPC') ELSE concat('Document ', doc_id) END"})
scalar("dat06_cutoff", "orders", "o_orderkey", {"age": "AGE(CAST(o_orderdate AS DATE))"}, {"kept_30": "age <= 30", "kept_365": "age <= 365"})


@query("dat08_durations", "SELECT user_id, date_diff('second', min(date_trunc('second', ts)), max(date_trunc('second', ts))) // 60 AS minutes, round(date_diff('second', min(date_trunc('second', ts)), max(date_trunc('second', ts))) / 3600.0::DOUBLE, 6) AS hours, round(date_diff('day', min(ts::DATE), max(ts::DATE)) / 365.0::DOUBLE, 6) AS years FROM events GROUP BY user_id")
def _(t):
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    g = t("events").groupBy("user_id").agg((F.max(s) - F.min(s)).alias("s"), F.datediff(F.max(F.to_date("ts")), F.min(F.to_date("ts"))).alias("d"))
    return g.select("user_id", F.expr("s div 60").alias("minutes"), r(F.col("s") / 3600.0).alias("hours"), r(F.col("d") / 365.0).alias("years"))


# -- candidates


def _legs(t) -> tuple[DataFrame, DataFrame]:
    """Two legs' scores: how close a vector is to the first one, and the share of a text's words that are its commonest."""
    v = t("embeddings")
    first = v.where("vec_id = 0").select(F.col("embedding").alias("q"))
    near = v.join(F.broadcast(first)).select(F.col("vec_id").alias("doc_id"), search.cosine(F.col("embedding"), F.col("q")).alias("score")).where("score > 0.1")
    words = t("documents").select("doc_id", (F.regexp_count(F.lower("text"), F.lit("the")) * 3.0 / F.greatest(F.length("text"), F.lit(1))).alias("score"))
    return near, words.where("score > 0")


_LEGS = """(SELECT e.vec_id AS doc_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) > 0.1) v
    FULL JOIN (SELECT doc_id, len(regexp_extract_all(lower(text), 'the')) * 3.0::DOUBLE / greatest(length(text), 1) AS score FROM documents WHERE contains(lower(text), 'the')) k ON v.doc_id = k.doc_id"""


@query("joi05_candidates", f"SELECT coalesce(v.doc_id, k.doc_id) AS doc_id, round(coalesce(v.score, 0), 6) AS vec, round(coalesce(k.score, 0), 6) AS kw FROM {_LEGS}")
def _(t):
    v, k = _legs(t)
    both = v.withColumnRenamed("score", "v").join(k.withColumnRenamed("score", "k"), "doc_id", "full_outer")
    return both.select("doc_id", r(F.coalesce("v", F.lit(0.0))).alias("vec"), r(F.coalesce("k", F.lit(0.0))).alias("kw"))


@query("joi06_base_first", f"SELECT coalesce(v.doc_id, k.doc_id) AS doc_id, round(coalesce(v.score, k.score), 6) AS score, v.doc_id IS NOT NULL AS from_vector FROM {_LEGS}")
def _(t):
    v, k = _legs(t)
    both = v.withColumnRenamed("score", "v").join(k.withColumnRenamed("score", "k"), "doc_id", "full_outer")
    return both.select("doc_id", r(F.coalesce("v", "k")).alias("score"), F.isnotnull("v").alias("from_vector"))


@query("joi08_renumbered", "SELECT d.doc_id, a.n_name AS new_to_old, b.n_nationkey::BIGINT AS old_to_new FROM documents d LEFT JOIN nation a ON a.n_nationkey = d.doc_id % 30 LEFT JOIN nation b ON b.n_name = CASE WHEN d.doc_id % 2 = 0 THEN 'FRANCE' ELSE 'ATLANTIS' END")
def _(t):
    n = t("nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    d = t("documents").selectExpr("doc_id", "doc_id % 30 as key", "case when doc_id % 2 = 0 then 'FRANCE' else 'ATLANTIS' end as name")
    return d.join(n.withColumnRenamed("name", "new_to_old"), "key", "left").drop("key").join(n.withColumnRenamed("key", "old_to_new"), "name", "left").select("doc_id", "new_to_old", "old_to_new")


_DATED = f"(SELECT vec_id, embedding, vec_id % 7 AS act, {_SQL_DOC.replace('doc_id', 'vec_id')} AS day FROM embeddings)"
_SIM = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


def _search(t, vec_id: int, where: str, k: int) -> DataFrame:
    e = t("embeddings").select("vec_id", "embedding", (F.col("vec_id") % 7).alias("act"), F.expr(_SPARK_DOC.replace("doc_id", "vec_id")).alias("day"))
    q = t("embeddings").where(F.col("vec_id") == vec_id).first().embedding  # one row, by its id
    return search.nearest(e.where(where), q, k, "vec_id").select("vec_id", r("sim").alias("sim"))


def _found(vec_id: int, where: str, k: int) -> str:
    return f"SELECT e.vec_id, round({_SIM}, 6) AS sim FROM {_DATED} e, embeddings q WHERE q.vec_id = {vec_id} AND {where} ORDER BY {_SIM} DESC, e.vec_id LIMIT {k}"


@query("rnk03_statute_search", _found(3, "act = 2 AND day <= DATE '2010-06-01'", 50))
def _(t): return _search(t, 3, "act = 2 and day <= date'2010-06-01'", 50)


@query("rnk04_case_search", _found(4, "day IS NOT NULL AND day <= DATE '2015-06-01' AND CAST(e.vec_id AS VARCHAR) ILIKE '1%'", 60))
def _(t): return _search(t, 4, "day is not null and day <= date'2015-06-01' and cast(vec_id as string) ilike '1%'", 60)


@query("rnk05_similar_by_id", _found(5, "e.vec_id <> 5", 19))
def _(t): return _search(t, 5, "vec_id <> 5", 19)


scalar("rnk10_party_hits", "documents", "doc_id", RANKED, {"ranked": double("score + CASE WHEN contains(lower(body), 'ram lal') THEN 0.05 ELSE 0.0 END + CASE WHEN contains(lower(body), 'state') THEN 0.05 ELSE 0.0 END + CASE WHEN contains(body, 'AIR 1977 SC') THEN 0.05 ELSE 0.0 END")})

# fixed values: synonyms of query terms
SYNONYMS = [
    ("bail", ["anticipatory bail", "pre-arrest bail", "s 438", "sec 438", "section 438", "crpc 438", "regular bail", "interim bail", "default bail", "surety", "custody", "custodial interrogation"]),
    ("arrest", ["custody", "detention", "apprehend"]),
    ("remand", ["custody", "judicial remand"]),
    ("fir", ["first information report", "crime report"]),
    ("habeas", ["habeas corpus", "illegal detention"]),
    ("writ", ["mandamus", "certiorari", "prohibition", "quo warranto"]),
    ("appeal", ["appellate", "challenge", "review"]),
    ("revision", ["criminal revision", "review petition"]),
    ("robbery", ["dacoity", "armed theft", "extortion", "snatching"]),
    ("murder", ["homicide", "culpable homicide"]),
    ("sexual", ["rape", "sexual assault", "outraging modesty"]),
    ("negligence", ["rash act", "breach of duty"]),
    ("cheating", ["fraud", "dishonestly"]),
    ("evidence", ["testimony", "proof", "material evidence"]),
    ("contract", ["agreement", "covenant"]),
    ("jurisdiction", ["competence", "authority"]),
    ("mens", ["intention", "mens rea"]),
    ("actus", ["act", "actus reus"]),
    ("sentence", ["punishment", "imprisonment", "fine"]),
    ("482", ["section 482", "482 crpc", "quash", "quash fir", "inherent powers"]),
    ("quash", ["482", "quash fir", "inherent powers"]),
    ("electronic", ["section 65b", "65-b certificate", "electronic record", "secondary evidence"]),
    ("article", ["article 14", "article 21", "fundamental rights", "arbitrary", "fair procedure"]),
    ("procedure", ["remand", "investigation", "cognizable", "non-cognizable", "compounding"]),
    ("precedent", ["binding precedent", "ratio decidendi", "article 141"]),
]
_SYN = ", ".join(f"('{w}', {s})" for w, s in SYNONYMS)
_ASKED = "CASE doc_id % 4 WHEN 0 THEN 'robbery and murder' WHEN 1 THEN 'bail after arrest, remand and quash of fir 482' WHEN 2 THEN 'murder' ELSE 'lease' END"


def _expansions(t) -> DataFrame:
    asked = t("documents").selectExpr("doc_id", f"{_ASKED} as q")
    each = [F.when(F.contains("q", F.lit(w)), F.array(*map(F.lit, s))).otherwise(F.array().cast("array<string>")) for w, s in SYNONYMS]
    return asked.withColumn("s", F.slice(F.array_sort(F.array_distinct(F.concat(*each))), 1, 40))


_EXPANDED = f"(SELECT doc_id, q, list_sort(list(DISTINCT s) FILTER (s IS NOT NULL))[1:40] AS s FROM (SELECT doc_id, {_ASKED} AS q FROM documents) LEFT JOIN (SELECT w, unnest(x) AS s FROM (VALUES {_SYN}) v(w, x)) ON contains(q, w) GROUP BY doc_id, q)"


@query("rnk12_synonyms", f"SELECT doc_id, coalesce(array_to_string(s[1:40], ' | '), '') AS issue FROM {_EXPANDED}")
def _(t): return _expansions(t).select("doc_id", F.array_join("s", " | ").alias("issue"))


@query("rnk13_expansion", f"SELECT doc_id, trim(q || ' ' || coalesce(array_to_string(s, ' '), '')) AS expanded FROM {_EXPANDED}")
def _(t): return _expansions(t).select("doc_id", F.trim(F.concat_ws(" ", "q", F.array_join("s", " "))).alias("expanded"))


@query("rnk14_sections", "SELECT doc_id, section, 1.0::DOUBLE AS score, true AS fallback_match FROM (SELECT doc_id, regexp_extract(text, '([0-9]{2,3})', 1) AS section FROM documents) WHERE section IN ('12', '13', '20', '23', '55', '555', '127', '743', '212', '302')")
def _(t): return t("documents").select("doc_id", F.regexp_extract("text", "([0-9]{2,3})", 1).alias("section"), F.lit(1.0).alias("score"), F.lit(True).alias("fallback_match")).where(F.col("section").isin("12", "13", "20", "23", "55", "555", "127", "743", "212", "302"))


@query("rnk17_resolver", "WITH h AS (SELECT conv_id, turn, (contains(lower(text), 'the')::INT + contains(lower(text), 'de')::INT + contains(lower(text), 'an')::INT)::BIGINT AS hits, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY hits DESC NULLS LAST, turn) AS k FROM h) SELECT conv_id, turn, hits FROM n WHERE (k <= 2 AND hits > 0) OR turn = last")
def _(t):
    hits = sum((F.contains(F.lower("text"), F.lit(w)).cast("long") for w in ("the", "de", "an")), F.lit(0).cast("long"))
    of = Window.partitionBy("conv_id")
    n = t("conversations").select("conv_id", "turn", hits.alias("hits")).withColumns({"last": F.max("turn").over(of), "k": F.row_number().over(of.orderBy(F.desc_nulls_last("hits"), "turn"))})
    return n.where("(k <= 2 and hits > 0) or turn = last").select("conv_id", "turn", "hits")


@query("rnk36_episodes", f"WITH w AS (SELECT doc_id, list_distinct({_WORDS.replace('text', BODY)}) AS w FROM documents), j AS (SELECT doc_id, len(list_intersect(w, ['the', 'court', 'shall,', 'as', 'on', 'and'])) AS shared, len(w) AS n FROM w) SELECT doc_id, round(shared / (n + 6 - shared), 6) AS likeness FROM j WHERE shared / (n + 6 - shared) > 0.1 AND doc_id % 100 >= 30 AND doc_id * 7 % 900 <= 365")
def _(t):
    recent = t("documents").where("doc_id % 100 >= 30 and doc_id * 7 % 900 <= 365").select("doc_id", T.word_set(F.expr(BODY)).alias("w"))
    both = F.size(F.array_intersect("w", F.array(*map(F.lit, ["the", "court", "shall,", "as", "on", "and"]))))
    return recent.select("doc_id", (both / (F.size("w") + 6 - both)).alias("l")).where("l > 0.1").select("doc_id", r("l").alias("likeness"))


# -- reports and orders


@query("agg34_citations", "SELECT flag AS kind, count(*) AS n, round(count(*) FILTER (verified) / count(*), 6) AS verified_rate, round(avg(relevance), 6) AS relevance FROM (SELECT l_returnflag AS flag, l_linestatus = 'F' AS verified, l_discount * 10 AS relevance FROM lineitem) GROUP BY 1")
def _(t): return t("lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(F.count(F.lit(1)).alias("n"), r(F.count_if(F.col("l_linestatus") == "F") / F.count(F.lit(1))).alias("verified_rate"), r(F.avg(F.col("l_discount") * 10)).alias("relevance"))


@query("agg36_by_owner", "SELECT doc_id % 9 AS owner, count(*) AS n, count(*) FILTER (lang = 'en') AS english, count(*) FILTER (n_chars > 1000) AS long FROM documents GROUP BY 1")
def _(t): return t("documents").groupBy(F.expr("doc_id % 9").alias("owner")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("lang = 'en'")).alias("english"), F.count_if(F.expr("n_chars > 1000")).alias("long"))


@query("agg38_all_sources", "SELECT sum(n)::BIGINT AS total FROM (SELECT count(*) AS n FROM documents WHERE contains(text, 'the') UNION ALL SELECT count(*) FROM pages WHERE contains(html, 'the'))")
def _(t):
    hits = t("documents").select(F.col("text").alias("b")).unionAll(t("pages").select(F.col("html").alias("b")))
    return hits.agg(F.count_if(F.contains("b", F.lit("the"))).alias("total"))


@query("top06_stable_ties", "SELECT event_id, floor(value / 10)::BIGINT AS score FROM events ORDER BY score DESC NULLS LAST, event_id LIMIT 25")
def _(t): return t("events").select("event_id", F.floor(F.col("value") / 10).alias("score")).orderBy(F.desc_nulls_last("score"), "event_id").limit(25)


_DATES = "'([0-9]{2}/[0-9]{2}/[0-9]{4})'"
_LINE = f"(SELECT doc_id, day, instr(b, day) AS at, substring(b, greatest(instr(b, day) - 100, 1), 200) AS context FROM (SELECT doc_id, b, unnest(list_distinct(regexp_extract_all(b, {_DATES}))) AS day FROM (SELECT doc_id, {BODY} AS b FROM documents)))"


def _timeline(t) -> DataFrame:
    found = t("documents").select("doc_id", F.expr(BODY).alias("b")).select("doc_id", "b", F.explode(F.array_distinct(F.expr(f"regexp_extract_all(b, {_DATES}, 1)"))).alias("day"))
    return found.select("doc_id", "day", F.expr("instr(b, day)").cast("long").alias("at"), F.expr("substring(b, greatest(instr(b, day) - 100, 1), 200)").alias("context"))


@query("ext14_timeline", f"SELECT * FROM {_LINE}")
def _(t): return _timeline(t)


@query("top08_by_date_text", f"SELECT doc_id, day FROM {_LINE} ORDER BY day, doc_id LIMIT 50")
def _(t): return _timeline(t).select("doc_id", "day").orderBy("day", "doc_id").limit(50)


_COST = "length(coalesce(text, '')) // 4 + CASE WHEN turn % 3 = 0 THEN 20 ELSE 0 END"


@query("win07_budget_with_skips", f"WITH RECURSIVE c AS (SELECT conv_id, turn, {_COST} AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY length(coalesce(text, '')) // 4, turn) AS k FROM conversations), f AS (SELECT conv_id, turn, k, cost <= 200 AS fits, CASE WHEN cost <= 200 THEN cost ELSE 0 END AS used FROM c WHERE k = 1 UNION ALL SELECT c.conv_id, c.turn, c.k, used + cost <= 200, CASE WHEN used + cost <= 200 THEN used + cost ELSE used END FROM f JOIN c ON c.conv_id = f.conv_id AND c.k = f.k + 1) SELECT conv_id, turn, fits FROM f")
def _(t):
    def step(used: int, row: tuple) -> tuple[int, bool]:
        fits = used + row.cost <= 200
        return used + row.cost * fits, fits

    costs = t("conversations").selectExpr("conv_id", "turn", "length(coalesce(text, '')) div 4 as tokens").selectExpr("*", "tokens + case when turn % 3 = 0 then 20 else 0 end as cost")
    return tables.carried(costs, ["tokens", "turn"], 0, step, "fits").select("conv_id", "turn", "fits")


# -- units of statutes and judgments

_STATUTE = "concat('Section 1. ', coalesce(text, ''), ' Illustration A does so. Explanation This holds. Provided that ', lang, ' is read.')"
_UNITS = f"(SELECT doc_id, unnest(range(len(p))) AS k, unnest(p) AS unit FROM (SELECT doc_id, string_split(regexp_replace({_STATUTE}, '(Illustration|Explanation|Provided that)', chr(1) || '\\1', 'g'), chr(1)) AS p FROM documents))"
_TYPE = "CASE WHEN starts_with(unit, 'Illustration') THEN 'Illustration' WHEN starts_with(unit, 'Explanation') THEN 'Explanation' WHEN starts_with(unit, 'Provided') THEN 'Proviso' ELSE 'Section' END"


def _units(t) -> DataFrame:
    cut = F.split(F.regexp_replace(F.expr(_STATUTE), "(Illustration|Explanation|Provided that)", "\x01$1"), "\x01")
    return t("documents").select("doc_id", F.posexplode(cut).alias("k", "unit"))


@query("chk04_statute_units", f"SELECT doc_id, k, trim(unit) AS unit, {_TYPE} AS unit_type, round(doc_id % 511 + 0.1::DOUBLE * k, 2) AS place FROM {_UNITS}")
def _(t): return _units(t).select("doc_id", F.col("k").cast("long").alias("k"), F.trim("unit").alias("unit"), F.expr(_TYPE.replace("starts_with", "startswith")).alias("unit_type"), r(F.expr("doc_id % 511 + 0.1D * k"), 2).alias("place"))


@query("chk05_unit_parts", f"SELECT doc_id, k, i // 800 + 1 AS part, array_to_string(w[i + 1:i + 800], ' ') AS text FROM (SELECT doc_id, k, w, unnest(range(0, greatest(len(w), 1), 800)) AS i FROM (SELECT doc_id, k, regexp_extract_all(unit, '\\S+') AS w FROM {_UNITS}))")
def _(t):
    words = _units(t).withColumn("w", F.regexp_extract_all("unit", F.lit("\\S+"), F.lit(0)))
    parts = F.expr("transform(sequence(0, greatest(size(w) - 1, 0) div 800), i -> array_join(slice(w, cast(i * 800 + 1 as int), 800), ' '))")
    return words.select("doc_id", F.col("k").cast("long").alias("k"), F.posexplode(parts).alias("part", "text")).withColumn("part", F.col("part").cast("long") + 1)


_CASE = "concat('FACTS ', chr(10), coalesce(text, ''), chr(10), 'ISSUES ', chr(10), lang, chr(10), 'JUDGMENT ', chr(10), source)"


@query("chk10_case_sections", f"SELECT doc_id, regexp_extract(s, '^([A-Z]+)', 1) AS heading, trim(regexp_replace(s, '^[A-Z]+\\s+', '')) AS body FROM (SELECT doc_id, unnest(string_split(regexp_replace({_CASE}, '(?m)^(FACTS|ISSUES|ARGUMENTS|JUDGMENT|ORDER)', chr(1) || '\\1', 'g'), chr(1))) AS s FROM documents) WHERE s <> ''")
def _(t):
    cut = F.split(F.regexp_replace(F.expr(_CASE), "(?m)^(FACTS|ISSUES|ARGUMENTS|JUDGMENT|ORDER)", "\x01$1"), "\x01")
    each = t("documents").select("doc_id", F.explode(cut).alias("s")).where("s <> ''")
    return each.select("doc_id", F.regexp_extract("s", "^([A-Z]+)", 1).alias("heading"), F.trim(F.regexp_replace("s", r"^[A-Z]+\s+", "")).alias("body"))


# -- evidence for claims

_SAID = "concat('It says \"', substring(replace(coalesce(text, ''), '\"', ' '), 40, 30), '\" and \"nothing of that kind at all\".')"
_QUOTE = "'\"([^\"]{10,})\"'"


@query("ver01_quotes", f"SELECT q.doc_id, quote, contains(replace(coalesce(d.text, ''), '\"', ' '), quote) AS found FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all({_SAID}, {_QUOTE}, 1))) AS quote FROM documents) q JOIN documents d ON d.doc_id = q.doc_id - q.doc_id % 2")
def _(t):
    d = t("documents")
    quotes = d.select("doc_id", F.explode(F.array_distinct(F.expr(f"regexp_extract_all({_SAID}, {_QUOTE}, 1)"))).alias("quote")).withColumn("named", F.expr("doc_id - doc_id % 2"))
    named = d.select(F.col("doc_id").alias("named"), F.expr("replace(coalesce(text, ''), '\"', ' ')").alias("said"))
    return quotes.join(named, "named").select("doc_id", "quote", F.contains("said", "quote").alias("found"))


@query("ver03_support", "WITH w AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}')) AS w FROM conversations), c AS (SELECT a.conv_id, a.turn, len(a.w) AS n, max(len(list_intersect(a.w, b.w))) AS most, count(b.turn) AS chunks FROM w a LEFT JOIN w b ON b.conv_id = a.conv_id AND b.role = 'user' WHERE a.role = 'assistant' GROUP BY ALL) SELECT conv_id, turn, CASE WHEN n = 0 THEN chunks > 0 ELSE coalesce(most, 0) >= 0.6 * n END AS supported FROM c")
def _(t):
    c = t("conversations").select("conv_id", "turn", "role", F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0))).alias("w"))
    claims, chunks = c.where("role = 'assistant'"), c.where("role = 'user'")
    shared = claims.select("conv_id", "turn", F.explode("w").alias("word")).join(chunks.select("conv_id", F.col("turn").alias("at"), F.explode("w").alias("word")), ["conv_id", "word"])
    most = shared.groupBy("conv_id", "turn", "at").agg(F.count(F.lit(1)).alias("n")).groupBy("conv_id", "turn").agg(F.max("n").alias("most"))
    told = claims.join(most, ["conv_id", "turn"], "left").join(chunks.select("conv_id").distinct().withColumn("any", F.lit(True)), "conv_id", "left")
    return told.select("conv_id", "turn", F.when(F.size("w") == 0, F.coalesce("any", F.lit(False))).otherwise(F.coalesce("most", F.lit(0)) >= 0.6 * F.size("w")).alias("supported"))


@query("cmp02_cross_references", "WITH s AS (SELECT doc_id, doc_id % 511 AS section, (doc_id % 9, doc_id % 900) AS cited FROM documents), f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY section) AS a, min(doc_id) OVER (PARTITION BY cited) AS b FROM s) SELECT doc_id, CASE WHEN b < doc_id THEN b ELSE a END AS refers_to, CASE WHEN b < doc_id THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS strength FROM f WHERE a < doc_id OR b < doc_id")
def _(t):
    """Each document with the first one that it shares a citation, else a section, with: references counted by key, never paired."""
    s = t("documents").select("doc_id", F.expr(BODY).alias("t")).select("doc_id", F.regexp_extract("t", "Under Section ([0-9]+) IPC and Article [0-9]+ of the Constitution, as held", 1).alias("section"), F.regexp_extract("t", r"([0-9]+ SCC [0-9]+) and AIR [0-9]+ SC [0-9]+, \[Doc[0-9]\]", 1).alias("cited"))
    first = lambda key: s.groupBy(key).agg(F.min("doc_id").alias(f"by_{key}"))
    f = s.join(first("section"), "section").join(first("cited"), "cited")
    nearer = F.col("by_cited") < F.col("doc_id")
    return f.where(nearer | (F.col("by_section") < F.col("doc_id"))).select("doc_id", F.when(nearer, F.col("by_cited")).otherwise(F.col("by_section")).alias("refers_to"), F.when(nearer, 0.9).otherwise(0.7).alias("strength"))


# -- event time

_TOKEN = 20 * 3600 * 1_000_000  # a token's time in microseconds
_AT = "SELECT user_id, event_id, epoch_us(ts) AS moment, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events"


def _events(t) -> DataFrame:
    return t("events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")


@query("stm02_token_bucket", f"WITH RECURSIVE e AS ({_AT}), b AS (SELECT user_id, event_id, moment, k, true AS admitted, {2 * _TOKEN}::BIGINT - {_TOKEN} AS held FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.moment, e.k, least({2 * _TOKEN}, held + e.moment - b.moment) >= {_TOKEN}, least({2 * _TOKEN}, held + e.moment - b.moment) - CASE WHEN least({2 * _TOKEN}, held + e.moment - b.moment) >= {_TOKEN} THEN {_TOKEN} ELSE 0 END FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1) SELECT user_id, event_id, admitted FROM b")
def _(t): return windows.spend(_events(t), _TOKEN, 2).select("user_id", "event_id", "admitted")


@query("stm03_request_limit")
def _(t): return windows.limit_requests(_events(t), 2, 86_400_000_000, _TOKEN, 2).select("user_id", "event_id", "admitted")


@query("stm04_spending", "SELECT user_id, date_trunc('day', ts) AS day, round(sum(value), 4) AS spent, sum(value) > 100 AS over_limit FROM events GROUP BY 1, 2")
def _(t): return t("events").groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.sum("value").alias("s")).select("user_id", F.col("w.start").alias("day"), r("s", 4).alias("spent"), (F.col("s") > 100).alias("over_limit"))


_TRAIL = "(SELECT unnest(range(date_trunc('minute', ts) - INTERVAL {m} MINUTE, date_trunc('minute', ts) + INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS start, * FROM events)"


@query("stm05_trailing", f"SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {_TRAIL.format(m=59)} GROUP BY start, event_type")
def _(t): return windows.windowed_stats(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "60 minutes", "1 minute").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r("total", 4).alias("total"))


@query("stm06_error_rate", f"SELECT start, count(*) AS n, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate FROM {_TRAIL.format(m=4)} GROUP BY start")
def _(t): return t("events").groupBy(F.window("ts", "5 minutes", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("event_type = 'error'")).alias("e")).select(F.col("w.start").alias("start"), "n", r(F.col("e") / F.col("n")).alias("error_rate"))


@query("stm09_timers", "WITH n AS (SELECT user_id, event_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS till FROM events WHERE event_type IN ('click', 'view')) SELECT user_id, event_id, epoch_us(till) - epoch_us(ts) AS micros FROM n WHERE event_type = 'click' AND till IS NOT NULL")
def _(t):
    """A click starts a timer; the next view stops it and so does the next click."""
    till: Column = F.lead("at").over(Window.partitionBy("user_id").orderBy("at", "event_id"))
    marks = t("events").where("event_type in ('click', 'view')").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return marks.withColumn("till", till).where("event_type = 'click' and till is not null").select("user_id", "event_id", (F.col("till") - F.col("at")).alias("micros"))

# -- claims, headnotes, near-duplicate chunks

_FLAGS = R.CLAIM_FLAGS | R.RISK_FLAGS
_SENTENCES = f"concat(coalesce(text, ''), '. ', {BODY}, ' It must always be filed within 30 days')"


@query("ver02_claim_indicators", f"SELECT doc_id, k, {', '.join(f'{R.duck(f)} AS {n}' for n, f in _FLAGS.items())} FROM (SELECT doc_id, unnest(range(len(p))) AS k, lower(regexp_replace(unnest(p), '^\\s+|\\s+$', '', 'g')) AS s FROM (SELECT doc_id, string_split_regex({_SENTENCES}, '[.!?]+') AS p FROM documents)) WHERE length(s) >= 10 AND ({' OR '.join(R.duck(f) for f in R.CLAIM_FLAGS.values())})")
def _(t):
    trimmed = F.transform(F.split(F.expr(_SENTENCES), "[.!?]+"), lambda s: F.lower(F.regexp_replace(s, r"^\s+|\s+$", "")))  # before they are rows: later every flag would do it again
    each = t("documents").select("doc_id", F.posexplode(trimmed).alias("k", "s"))
    claims = {n: R.column(f"{R.any_of('s', R.CLAIM_WORDS[n])} AND {f}") for n, f in R.CLAIM_FLAGS.items()}
    worth = each.where("length(s) >= 10").where(R.any_of("s", sorted({w for words in R.CLAIM_WORDS.values() for w in words})))
    flagged = worth.select("doc_id", F.col("k").cast("long").alias("k"), *[claims.get(n, R.column(f)).alias(n) for n, f in _FLAGS.items()])
    return flagged.where(" or ".join(R.CLAIM_FLAGS))


_HEAD = "regexp_replace(regexp_replace(lower(trim(regexp_replace(string_split(text, chr(10))[1], '\\s+', ' ', 'g'))), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+', ' ', 'g')"


@query("dup04_headnotes", f"SELECT doc_id, {_HEAD} IS NULL OR doc_id = min(doc_id) OVER (PARTITION BY {_HEAD}) AS kept FROM documents")
def _(t):
    """Of documents whose headnotes (first lines) are alike the first keeps its own; hashes are counted before they meet the rows."""
    heads = t("documents").select("doc_id", T.content_hash(F.split("text", "\n")[0]).alias("h"))
    first = heads.groupBy("h").agg(F.min("doc_id").alias("first"))
    return heads.join(first, "h", "left").select("doc_id", (F.isnull("h") | (F.col("doc_id") == F.col("first"))).alias("kept"))


@query("joi12_section_in_other", "WITH s AS (SELECT doc_id, doc_id % 511 AS n FROM documents) SELECT a.doc_id, b.doc_id AS other, CAST(a.n AS VARCHAR) AS section FROM s a JOIN s b ON a.n = b.n AND a.doc_id <> b.doc_id WHERE a.doc_id % 100 = 0")
def _(t):
    """For documents whose ids are divisible by 100, the others that name the same section: references joined by their value."""
    s = t("documents").select("doc_id", F.expr(BODY).alias("t")).select("doc_id", F.regexp_extract("t", "Under Section ([0-9]+) IPC and Article", 1).alias("section"))
    return s.where("doc_id % 100 = 0").join(s.withColumnRenamed("doc_id", "other"), "section").where("doc_id <> other").select("doc_id", "other", "section")


@query("joi13_near_chunks")
def _(t): return chunks.near_in_document(t("documents"), "doc_id", "text", 95)

# -- resolvers, widening, sections of offences

# fixed values: the section that an offence points to
OFFENCES = [("robbery", "147"), ("dacoity", "149"), ("murder", "101"), ("homicide", "103"), ("culpable", "103"), ("theft", "303"), ("cheating", "356"), ("breach of trust", "357"), ("rape", "63"), ("sexual assault", "63"), ("wrongful restraint", "351"), ("criminal intimidation", "351"), ("kidnapping", "133"), ("dowry death", "111")]
_CRIME = f"concat(({[o for o, _ in OFFENCES]})[CAST(doc_id % 14 AS INTEGER) + 1], ' or ', ({[o for o, _ in OFFENCES]})[CAST(doc_id * 5 % 14 AS INTEGER) + 1])"


@query("ext04_section_guesses", f"SELECT DISTINCT doc_id, 'BNS:2023:Sec:' || n AS canonical FROM (SELECT doc_id, {_CRIME} AS q FROM documents) JOIN (VALUES {', '.join(map(str, OFFENCES))}) o(w, n) ON contains(q, w)")
def _(t):
    names = F.array(*[F.lit(o) for o, _ in OFFENCES])
    nth = lambda e: F.get(names, F.expr(e).cast("int"))
    asked = t("documents").select("doc_id", F.concat(nth("doc_id % 14"), F.lit(" or "), nth("doc_id * 5 % 14")).alias("q"))
    hits = F.array_compact(F.array(*[F.when(F.contains("q", F.lit(o)), F.lit(f"BNS:2023:Sec:{n}")) for o, n in OFFENCES]))
    return asked.select("doc_id", F.explode(F.array_distinct(hits)).alias("canonical"))


scalar("rnk11_prefix_query", "documents", "doc_id", {"w": "regexp_replace(trim(regexp_replace(lower(substring(coalesce(text, ''), 1, 60)), '[^a-z0-9]+', ' '@G)), ' +', ' '@G)"}, {"prefixes": "CASE WHEN w = '' THEN '' ELSE concat(replace(w, ' ', ':* & '), ':*') END", "phrase": "replace(w, ' ', ' <-> ')", "either": "replace(w, ' ', ' | ')"})
scalar("rnk15_parties", "documents", "doc_id", {"t": "lower(coalesce(text, ''))", "q": "CASE WHEN doc_id % 2 = 0 THEN 'held in the case of the v. der' ELSE 'ruling in la vs. le' END"}, {"a": "regexp_extract(q, '([a-z]+) vs?[.] ([a-z]+)', 1)", "b": "regexp_extract(q, '([a-z]+) vs?[.] ([a-z]+)', 2)"}, {"resolved": "CASE WHEN contains(t, a) AND contains(t, b) THEN 'party_resolver' WHEN contains(t, a) OR contains(t, b) THEN 'party_resolver_or' END"})

_HINT = "regexp_extract_all(b, 'AIR [0-9]{4} SC [0-9]+'"
_HINTS = f"(SELECT doc_id, unnest(list_distinct({_HINT}))) AS hint FROM (SELECT doc_id, {BODY} AS b FROM documents))"


@query("rnk16_citation_resolver", f"WITH h AS (SELECT * FROM {_HINTS}) SELECT q.doc_id, h.doc_id AS found, q.hint FROM h q JOIN (SELECT *, row_number() OVER (PARTITION BY hint ORDER BY doc_id) AS k FROM h) h ON h.hint = q.hint AND h.k <= 8 WHERE q.doc_id % 100 = 0")
def _(t):
    """For questions (ids divisible by 100) the first eight documents with each citation that the question has."""
    h = t("documents").select("doc_id", F.expr(BODY).alias("b")).select("doc_id", F.explode(F.array_distinct(F.expr(f"{_HINT}, 0)"))).alias("hint"))
    first = h.withColumnRenamed("doc_id", "found").withColumn("k", F.row_number().over(Window.partitionBy("hint").orderBy("found"))).where("k <= 8")
    return h.where("doc_id % 100 = 0").join(first, "hint").select("doc_id", "found", "hint")


@query("rnk24_widened", f"WITH n AS (SELECT count(*) AS n FROM {_DATED} WHERE act = 2 AND vec_id < 50) SELECT e.vec_id, round({_SIM}, 6) AS sim FROM {_DATED} e, embeddings q, n WHERE q.vec_id = 6 AND (n.n < 20 OR (act = 2 AND e.vec_id < 50)) ORDER BY {_SIM} DESC, e.vec_id LIMIT 20")
def _(t):
    """One court's cases, all courts' where it has fewer than are asked for."""
    narrow, wide = _search(t, 6, "act = 2 and vec_id < 50", 20), _search(t, 6, "true", 20)
    found = narrow.agg(F.count(F.lit(1)).alias("n"))  # of 20 rows at most
    either = narrow.withColumn("own", F.lit(True)).unionByName(wide.withColumn("own", F.lit(False)))
    return either.join(F.broadcast(found)).where("own = (n = 20)").select("vec_id", "sim")


_NUMBERED = "concat('facts of it', chr(10), '1. ', coalesce(text, ''), chr(10), '2. The issue is this', chr(10), 'more', chr(10), '3. held so')"
_PART = "CASE WHEN contains(lower(body), 'held') THEN 'ratio' WHEN contains(lower(body), 'issue') THEN 'issues' WHEN contains(lower(body), 'facts') THEN 'facts' ELSE 'other' END"


@query("chk13_numbered", f"WITH l AS (SELECT doc_id, unnest(range(len(p))) AS k, unnest(p) AS line FROM (SELECT doc_id, string_split({_NUMBERED}, chr(10)) AS p FROM documents)), g AS (SELECT *, count(*) FILTER (regexp_matches(line, '^[0-9]+[.] ')) OVER (PARTITION BY doc_id ORDER BY k) AS para FROM l), b AS (SELECT doc_id, para, string_agg(line, chr(10) ORDER BY k) AS body FROM g GROUP BY doc_id, para) SELECT *, {_PART} AS part FROM b")
def _(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split(F.expr(_NUMBERED), "\n")).alias("k", "line"))
    para = F.count_if(F.expr("regexp_like(line, '^[0-9]+[.] ')")).over(Window.partitionBy("doc_id").orderBy("k"))
    body = lines.withColumn("para", para).groupBy("doc_id", "para").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return body.withColumn("part", F.expr(_PART))


@query("chk17_chunk_size", "SELECT round(greatest(2000.0::DOUBLE, least(8000.0::DOUBLE, avg(n_chars) / 10)), 4) AS size FROM documents")
def _(t): return t("documents").agg(r(F.greatest(F.lit(2000.0), F.least(F.lit(8000.0), F.avg("n_chars") / 10)), 4).alias("size"))


@query("src12_deleted", "WITH c AS (SELECT max(ts) - INTERVAL 10 DAY AS day FROM events) SELECT count(*) FILTER (ts < day) AS deleted, count(*) FILTER (ts >= day) AS kept FROM events, c")
def _(t):
    last = t("events").agg((F.max("ts") - F.expr("interval 10 days")).alias("day"))
    return t("events").join(F.broadcast(last)).agg(F.count_if(F.col("ts") < F.col("day")).alias("deleted"), F.count_if(F.col("ts") >= F.col("day")).alias("kept"))


@query("stm07_alerts", "WITH g AS (SELECT *, count(*) FILTER (value <= 20) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events), s AS (SELECT *, min(ts) FILTER (value > 20) OVER (PARTITION BY user_id, run) AS since FROM g) SELECT user_id, event_id, epoch_us(ts) - epoch_us(since) AS micros FROM s WHERE value > 20 AND epoch_us(ts) - epoch_us(since) >= 7200000000")
def _(t):
    """Rows at which a condition has held without a break for two hours or more, and for how long."""
    e = t("events").where("value is not null").select("user_id", "event_id", (F.col("value") > 20).alias("met"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    g = e.withColumn("run", F.count_if(~F.col("met")).over(Window.partitionBy("user_id").orderBy("at", "event_id")))
    since = F.min(F.when(F.col("met"), F.col("at"))).over(Window.partitionBy("user_id", "run"))
    return g.withColumn("micros", F.col("at") - since).where("met and micros >= 7200000000").select("user_id", "event_id", "micros")


ORACLE_SQL["stm01_admit"] = f"WITH RECURSIVE e AS ({_AT}), b AS (SELECT user_id, event_id, k, true AS admitted, [moment] AS held FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, len(list_filter(held, lambda x: x > moment - 86400000000)) < 2, CASE WHEN len(list_filter(held, lambda x: x > moment - 86400000000)) < 2 THEN list_append(list_filter(held, lambda x: x > moment - 86400000000), moment) ELSE held END FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1) SELECT user_id, event_id, admitted FROM b"
