"""More queries by operator id: scoring rules, extraction, filters, reports, windows and evaluation, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import rules as R
from ferrule.operators import percentiles, search, tables
from ferrule.plans.queries import _SPARK_DOC, _SQL_DOC, ORACLE_SQL, QUERIES, query, r  # noqa: F401  what is registered here joins the others

KIND = "CASE lang WHEN 'en' THEN 'statute' WHEN 'fr' THEN 'case_law' WHEN 'de' THEN 'regulation' ELSE 'user' END"
#: documents' texts with references, which the fixtures lack, after them
BODY = "concat(coalesce(text, ''), ' Under Section ', doc_id % 511, ' IPC and Article ', doc_id % 395, ' of the Constitution, as held in Ram Lal vs. State, (', 1950 + doc_id % 70, ') ', doc_id % 9 + 1, ' SCC ', doc_id % 900 + 1, ' and AIR ', 1950 + doc_id % 70, ' SC ', doc_id % 700 + 1, ', [Doc', doc_id % 5 + 1, '] and [', doc_id % 7, ']. The court shall, as on 1', doc_id % 9, '/0', doc_id % 8 + 1, '/20', doc_id % 10 + 10, ', decide \"that it may be so\" always.')"
#: what a ranking has of each candidate
RANKED = {
    "body": BODY,
    "kind": KIND,
    "score": "LEN(regexp_extract_all(coalesce(text, ''), '[aeiou]', 0)) * 1.0 / greatest(length(coalesce(text, '')), 1)",
    "section": "CASE WHEN HAS(coalesce(text, ''), '[0-9]') THEN regexp_extract(text, '([0-9]+)', 1) END",
    "part": "CASE source WHEN 'src1' THEN 'definition' WHEN 'src2' THEN 'ratio' WHEN 'src3' THEN 'procedure' ELSE 'other' END",
    "importance": "least(1.0, n_chars / 4000.0)",
    "bench": "LEN(regexp_extract_all(coalesce(text, ''), '\\n', 0)) + 1",
    "unit": "CASE WHEN contains(coalesce(text, ''), ';') OR n_chars > 1000 THEN 'Section' ELSE 'Proviso' END",
}


def double(rule: str, digits: int = 6) -> str:
    return f"round(CAST({rule} AS DOUBLE), {digits})"


def scalar(name: str, table: str, keys: str, *layers: dict[str, str]) -> None:
    """A query of rules alone: each layer adds columns to those before it; keys and the last layer's columns are returned."""
    sql, source = "", table
    for k, layer in enumerate(layers):
        sql += f"{', ' if k else 'WITH '}l{k} AS (SELECT *, {', '.join(f'{R.duck(e)} AS {n}' for n, e in layer.items())} FROM {source})"
        source = f"l{k}"
    out = [*keys.split(), *layers[-1]]

    @query(name, f"{sql} SELECT {', '.join(out)} FROM {source}")
    def _(t):
        df = t(table)
        for layer in layers:
            df = df.select("*", *[R.column(e).alias(n) for n, e in layer.items()])
        return df.select(*[F.col(c).cast("long") if kind == "int" else F.col(c) for c, kind in df.select(*out).dtypes])


# -- ranking rules

scalar("rnk21_authority", "documents", "doc_id", RANKED | {"kind": "CASE WHEN lang = 'en' THEN 'statute' ELSE 'case' END"}, {"authority": double(R.AUTHORITY)})
scalar("rnk20_recency_by_kind", "orders", "o_orderkey", {"kind": "CASE o_orderstatus WHEN 'O' THEN 'statute' WHEN 'F' THEN 'case' ELSE 'other' END", "day": "CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate END", "age": "AGE(CAST(o_orderdate AS DATE))"}, {"recency": double(R.RECENCY)})
scalar("rnk27_legal_boost", "documents", "doc_id", RANKED, {"boosted": double(R.legal_boost(["Section 12", "ipc", "constitution", "court", "Article 7"], ["AIR 1977 SC", "ram lal vs. state"]))})
scalar("rnk28_keyword_boost", "documents", "doc_id", RANKED, {"boosted": double(R.keyword_boost([("ram lal vs. state", 0.3), ("Section 12", 0.25), ("court", 0.2), ("shall", 0.1)]))})
scalar("rnk29_simple_boost", "documents", "doc_id", RANKED, {"boosted": double(R.keyword_boost([("section 12", 0.2), ("court", 0.15)]))}, {"kept": "length(body) >= 50 AND boosted >= 0.3", "final": "boosted"})
scalar("rnk30_relevance", "documents", "doc_id", RANKED, {"relevance": double(R.CHUNK_RELEVANCE)}, {"final": "relevance", "kept": "relevance >= 0.7"})
scalar("rnk31_intent", "documents", "doc_id", RANKED | {"question": "concat(CASE source WHEN 'src1' THEN 'what is ' WHEN 'src2' THEN 'how to ' WHEN 'src3' THEN 'the ruling on ' WHEN 'src4' THEN 'which section of ' WHEN 'src5' THEN 'penalty for ' ELSE '' END, lower(substring(coalesce(text, ''), 1, 80)))"}, {"intent": R.INTENT}, {"why": "intent", "boost": double(R.INTENT_BOOST)})
scalar("rnk33_citation_rank", "documents", "doc_id", RANKED | {"verified": "HAS(coalesce(text, ''), '[.]\\s*$')", "reference": "regexp_extract(coalesce(text, ''), '([0-9.]{4,})', 1)"}, {"rank_score": double(R.CITATION_RANK)})
scalar("fil13_floor_by_kind", "documents", "doc_id", RANKED | {"least_score": "0.7"}, {"floor": double(R.FLOOR_BY_KIND)}, {"passes": "score >= floor"})
scalar("rnk35_memory", "events", "event_id", {"overlap": "least(1.0, value / 40.0)", "importance": "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) / 100.0", "hours": "hour(ts) + 24 * (30 - day(ts))"}, {"relevance": double(R.MEMORY)}, {"final": "relevance", "kept": "importance >= 0.3 AND relevance > 0.5"})

# -- quality, importance, questions, claims

_WORDS = "LEN(regexp_extract_all(t, '\\S+', 0))"
_SENT = "1 + LEN(regexp_extract_all(t, '[.!?]+', 0))"
QUALITY = {"t": f"trim({BODY})"}, {"words": _WORDS, "sentence_words": f"{_WORDS} * 1.0 / ({_SENT})", "letters": "LEN(regexp_extract_all(t, '[a-zA-Z]', 0)) * 1.0 / greatest(length(t), 1)", "artefacts": "LEN(regexp_extract_all(t, '[!-/:-@\\[-`{-~]{3,}', 0))", "citations": "LEN(regexp_extract_all(t, 'AIR [0-9]{4} SC [0-9]+', 0)) + LEN(regexp_extract_all(t, '[(][0-9]{4}[)] [0-9]+ SCC [0-9]+', 0))", "keywords": R.count_of("lower(t)", R.LEGAL_TERMS), "titled": "1", "sectioned": "CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END"}
scalar("qlt01_quality", "documents", "doc_id", *QUALITY, {"length_score": double(R.LENGTH_SCORE), "whole_score": double(R.WHOLE_SCORE), "read_score": double(R.READ_SCORE), "legal_score": double(R.LEGAL_SCORE), "quality": double(R.QUALITY)})
scalar("qlt02_skip", "documents", "doc_id", *QUALITY, {"quality": R.QUALITY}, {"skip": R.SKIP})
scalar("qlt03_keep_score", "documents", "doc_id", *QUALITY, {"keep_score": double(R.KEEP_SCORE)})
scalar("qlt04_importance", "documents", "doc_id", *QUALITY, {"importance": double(R.IMPORTANCE)})
scalar("qlt05_ingestible", "documents", "doc_id", *QUALITY, {"reason": "CASE WHEN length(t) < 100 THEN 'short' WHEN length(t) > 1000000 THEN 'long' WHEN keywords < 3 THEN 'few keywords' END"})
_ASKED = {"question": "concat(CASE role WHEN 'user' THEN CASE WHEN turn = 0 THEN 'compare theft and robbery in ' WHEN turn = 2 THEN 'what is the procedure of ' ELSE 'punishment for theft, ' END ELSE '' END, lower(coalesce(text, '')))"}, {"words": "LEN(regexp_extract_all(question, '\\S+', 0))", "offences": R.count_of("question", ["theft", "robbery", "murder"]), "terms": R.count_of("question", ["punishment", "sentence", "procedure"]), "guesses": "CASE WHEN contains(question, 'theft') THEN 1 ELSE 0 END"}
scalar("ext02_question_type", "conversations", "conv_id turn", *_ASKED, {"type": R.QUESTION_TYPE})
scalar("ext03_clarify", "conversations", "conv_id turn", *_ASKED, {"type": R.QUESTION_TYPE}, {"ask": R.CLARIFY, "refuse": R.REFUSE})
scalar("rul01_complexity", "conversations", "conv_id turn", *_ASKED, {"complexity": R.COMPLEXITY})
_CLAIM = {"s": "lower(coalesce(text, ''))"}, {f: f"CASE WHEN {e} THEN 1 ELSE 0 END" for f, e in (("absolute", "HAS(s, '\\bthe\\b')"), ("uncited_number", "HAS(s, '[0-9]')"), ("recent", "HAS(s, '\\bthis\\b')"), ("complex", "n_chars > 1500"), ("definitive", "HAS(s, 'is')"))}
scalar("ver04_claim_risk", "documents", "doc_id", *_CLAIM, {"risk": double(R.CLAIM_RISK), "unsupported": "least(0.6, n_chars / 5000.0)"}, {"claim_risk": "risk", "level": R.RISK_LEVEL, "confidence": double("greatest(0.1, 1.0 - unsupported)")})
scalar("ver05_citation_faults", "documents", "doc_id", {"kind": "CASE WHEN doc_id % 2 = 0 THEN 'case_law' ELSE 'statute' END", "reference": "CASE doc_id % 5 WHEN 0 THEN 'Ram v. Lal, (1977) 2 SCC 3' WHEN 1 THEN 'Untitled document' WHEN 2 THEN '' WHEN 3 THEN 'Ram and Lal, 1977' ELSE 'Ram v Lal' END"}, {"fault": R.CITATION_FAULTS})
scalar("ver07_supported", "documents", "doc_id", {"t": BODY}, {"supported": "contains(t, '[Doc')"})
scalar("mth01_clamp", "events", "event_id", {"x": "value / 40.0 - 0.1"}, {"clamped": double("greatest(0.05, least(0.95, x))")})
scalar("mth04_tokens", "documents", "doc_id", {"t": "coalesce(text, '')"}, {"by_words": f"CAST(floor({_WORDS} * 1.3) AS BIGINT)"})
scalar("mth06_confidence", "lineitem", "l_orderkey l_linenumber", {"a": "l_quantity / 50.0", "b": "l_discount * 10", "c": "l_tax * 12.5"}, {"product": double("a * (0.5 + 0.5 * b) * (0.8 + 0.2 * c)"), "weighted": double("0.4 * a + 0.3 * b + 0.3 * c")})

# -- texts, extraction

scalar("str06_signs", "documents", "doc_id", {"t": "concat(coalesce(text, ''), ' ﬁnal – “quote” ‘x’ ﬂow')"}, {"plain": R.PLAIN_SIGNS})
scalar("str08_page_clean", "documents", "doc_id", {"t": "concat('Page 3', chr(10), coalesce(text, ''), chr(10), ' 17 ', chr(10), 'judg-', chr(10), 'ment', chr(7))"}, {"cleaned": R.PAGE_CLEAN})
scalar("str12_citation_names", "documents", "doc_id", {"t": f"concat({BODY}, ' A Versus B in the SUPREME COURT of India and high court')"}, {"normal": R.NORMAL_CITATION})
scalar("str13_phrases", "documents", "doc_id", {"t": f"concat({BODY}, ' WHOEVER SHALL, PROVIDED THAT it may, subject To')"}, {"standard": R.STANDARD})
scalar("str15_line_type", "documents", "doc_id", {"l": "CASE doc_id % 6 WHEN 0 THEN 'FINAL ORDER' WHEN 1 THEN '12. The facts' WHEN 2 THEN 'Ram v. State' WHEN 3 THEN '3 see above' WHEN 4 THEN '(a) one item' ELSE substring(coalesce(text, ''), 1, 60) END"}, {"type": R.LINE_TYPE})
scalar("str21_escape", "pages", "page_id", {"t": "coalesce(html, '')"}, {"escaped": R.ESCAPED, "file_name": R.FILE_NAME})
scalar("str21_validators", "documents", "doc_id", {"t": "CASE doc_id % 4 WHEN 0 THEN '+91 98765-43210' WHEN 1 THEN '123e4567-e89b-12d3-a456-426614174000' WHEN 2 THEN '12' ELSE coalesce(text, '') END"}, {"uuid": R.IS_UUID, "phone": R.IS_PHONE})
scalar("str23_devanagari", "documents", "doc_id", {"t": "CASE WHEN doc_id % 5 = 0 THEN concat('धारा एक दो तीन ', doc_id) ELSE coalesce(text, '') END"}, {"lang_by_script": R.DEVANAGARI})
scalar("str18_quote_match", "documents", "doc_id", {"t": f"regexp_replace(lower({BODY}), '\\s+', ' '@G)"}, {"quoted": "contains(t, 'that it may be so')"})
scalar("str17_topic", "documents", "doc_id", {"t": "regexp_replace(trim(coalesce(text, '')), '\\s+', ' '@G)"}, {"topic": "regexp_extract(t, '^((?:[^ ]+ ?){0,14})', 1)"})
scalar("fil21_canonical_id", "documents", "doc_id", {"section": "CASE WHEN HAS(coalesce(text, ''), '[0-9]') THEN regexp_extract(text, '([0-9]+)', 1) END"}, {"canonical": "concat(CAST(doc_id AS VARCHAR(20)), ':Sec:', coalesce(CAST(section AS VARCHAR(20)), 'None'))"})
scalar("ext05_citations", "documents", "doc_id", {"t": BODY}, {"scc": "JOINED(regexp_extract_all(t, '[(][0-9]{4}[)] [0-9]+ SCC [0-9]+', 0), '; ')", "n_air": "LEN(regexp_extract_all(t, 'AIR [0-9]{4} SC [0-9]+', 0))", "sections": "JOINED(regexp_extract_all(t, 'Section ([0-9]+)', 1), '; ')"})
scalar("ext06_statute_ids", "documents", "doc_id", {"t": BODY}, {"ipc": "CASE WHEN HAS(t, 'Section [0-9]+ IPC') THEN concat('IPC:Sec:', regexp_extract(t, 'Section ([0-9]+) IPC', 1)) END", "constitution": "CASE WHEN HAS(t, 'Article [0-9]+') THEN concat('COI:Art:', regexp_extract(t, 'Article ([0-9]+)', 1)) END"})
scalar("ext07_case_names", "documents", "doc_id", {"t": f"replace({BODY}, ' vs. ', ' v. ')"}, {"case_name": "regexp_extract(t, '([A-Z][a-z]+(?: [A-Z][a-z]+)* v[.] [A-Z][a-z]+)', 1)"})
scalar("ext11_jurisdiction", "documents", "doc_id", {"t": f"lower({BODY})"}, {"jurisdiction": "CASE WHEN contains(t, 'supreme court') THEN 'national' WHEN contains(t, 'state') THEN 'state' ELSE 'unknown' END"})
scalar("ext12_structure", "documents", "doc_id", {"t": f"lower({BODY})"}, {"shalls": "LEN(regexp_extract_all(t, '\\bshall\\b', 0))", "held": "LEN(regexp_extract_all(t, '\\bheld\\b', 0))", "courts": "LEN(regexp_extract_all(t, '\\bcourt\\b', 0))"})
scalar("ext13_markers", "documents", "doc_id", {"t": BODY}, {"docs": "JOINED(regexp_extract_all(t, '\\[Doc([0-9]+)\\]', 1), ' ')", "numbers": "JOINED(regexp_extract_all(t, '\\[([0-9]+)\\]', 1), ' ')"})
scalar("ext15_topics", "documents", "doc_id", {"t": f"lower({BODY})"}, {"criminal": R.any_of("t", ["ipc", "crime", "bail"]), "constitutional": R.any_of("t", ["constitution", "article"]), "follow_up": R.any_of("t", ["what about", "also", "as above"])})
scalar("dat02_build_date", "lineitem", "l_orderkey l_linenumber", {"y": "year(l_shipdate) % 100 + CASE WHEN l_returnflag = 'R' THEN 100 ELSE 0 END", "m": "month(l_shipdate)", "d": "day(l_shipdate) + l_linenumber % 4"}, {"year": "CASE WHEN y < 70 THEN y + 2000 WHEN y < 100 THEN y + 1900 ELSE y + 1900 END"}, {"day_text": "CASE WHEN d <= 28 OR (d <= 30 AND m <> 2) OR m IN (1, 3, 5, 7, 8, 10, 12) THEN concat(year, '-', m, '-', d) WHEN d = 29 AND m = 2 AND (year % 4 = 0 AND (year % 100 <> 0 OR year % 400 = 0)) THEN concat(year, '-', m, '-', d) ELSE concat(year, '-', m, '-28') END"})
scalar("dat03_as_on", "documents", "doc_id", {"t": BODY}, {"as_on": "regexp_extract(t, '(?:as on|as of|on|in|during|before|after) ([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})', 1)"})
scalar("dat05_iso", "documents", "doc_id", {"t": BODY}, {"found": "regexp_extract(t, '([0-9]{2}/[0-9]{2}/[0-9]{4})', 1)"}, {"iso": "concat(substring(found, 7, 4), '-', substring(found, 4, 2), '-', substring(found, 1, 2))"})
scalar("chk15_post", "documents", "doc_id", {"t": "trim(coalesce(text, ''))"}, {"words": _WORDS, "letters": "length(regexp_replace(t, '[^A-Za-z0-9_]', ''@G))"}, {"kept": "length(t) >= 30 AND letters >= 20", "n_words": "words"})

# -- filters


@query("fil01_optional", "SELECT doc_id FROM documents WHERE lang = 'en'")
def _(t): return tables.where_given(t("documents"), {"lang": "en", "source": None}).select("doc_id")


@query("fil05_post_filter", f"SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'unknown' WHEN doc_id % 4 = 1 THEN NULL ELSE strftime({_SQL_DOC}, '%Y-%m-%d') END AS s FROM documents) WHERE coalesce(TRY_CAST(s AS DATE) <= DATE '2010-06-01', true)")
def _(t):
    s = F.when(F.col("doc_id") % 4 == 0, "unknown").when(F.col("doc_id") % 4 > 1, F.date_format(F.expr(_SPARK_DOC), "yyyy-MM-dd"))
    return t("documents").where(F.coalesce(F.try_to_date(s, "yyyy-MM-dd") <= F.lit("2010-06-01").cast("date"), F.lit(True))).select("doc_id")


@query("fil10_fetch", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(t): return t("documents").join(t("labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "n_chars")


@query("fil12_similarity_floor", "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id FROM embeddings, q WHERE list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) >= 0.5")
def _(t):
    q = t("embeddings").where("vec_id = 0").first().embedding  # one row, by its id
    return search.nearest(t("embeddings"), q, None, "vec_id").where("sim >= 0.5").select("vec_id")


@query("fil14_exclude", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def _(t): return t("documents").join(t("labels").where("quality = 0").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("fil15_audit", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND event_type = 'error'")
def _(t): return tables.where_given(t("events").where("ts >= timestamp_ntz'2024-01-05' and ts < timestamp_ntz'2024-01-20'"), {"event_type": "error", "user_id": None}).select("event_id")


@query("fil16_facets", "SELECT doc_id FROM documents WHERE lang = 'en' AND list_has_any([source, lang], ['web', 'en']) AND contains(lower(text), 'the')")
def _(t): return tables.where_given(t("documents"), {"lang": "en"}).where(F.arrays_overlap(F.array("source", "lang"), F.array(F.lit("web"), F.lit("en"))) & F.contains(F.lower("text"), F.lit("the"))).select("doc_id")


@query("fil17_billable", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O' AND l_shipdate >= DATE '1998-01-01'")
def _(t): return tables.where_given(t("lineitem"), {"l_returnflag": "N", "l_linestatus": "O"}).where("l_shipdate >= date'1998-01-01'").select("l_orderkey", "l_linenumber")


@query("fil18_out_of_range", "SELECT count(*) AS n FROM documents WHERE length(text) // 4 > 800 OR length(text) // 4 < 80")
def _(t): return t("documents").where("length(text) div 4 > 800 or length(text) div 4 < 80").agg(F.count(F.lit(1)).alias("n"))


# -- joins

@query("joi02_search_talks", "SELECT DISTINCT a.conv_id FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id WHERE a.turn = 0 AND contains(lower(b.text), 'the')")
def _(t):
    hits = t("conversations").where(F.contains(F.lower("text"), F.lit("the"))).select("conv_id")
    return t("conversations").where("turn = 0").join(hits, "conv_id").select("conv_id").distinct()


@query("joi07_legacy", "SELECT d.doc_id, string_agg(CAST(n.n_name AS VARCHAR), ',' ORDER BY n.n_name) AS legacy FROM documents d LEFT JOIN nation n ON n.n_regionkey = d.doc_id % 7 GROUP BY d.doc_id")
def _(t):
    old = t("nation").groupBy(F.col("n_regionkey").cast("long").alias("k")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("legacy"))
    return t("documents").select("doc_id", (F.col("doc_id") % 7).alias("k")).join(old, "k", "left").select("doc_id", "legacy")


@query("joi10_expected_ranks", "WITH e AS (SELECT conv_id AS q, turn AS pos, turn % 3 AS id FROM conversations), r AS (SELECT q, id, min(pos) + 1 AS rank FROM e GROUP BY q, id) SELECT x.q, x.id, r.rank FROM (SELECT DISTINCT conv_id AS q, unnest([0::BIGINT, 1, 2]) AS id FROM conversations) x LEFT JOIN r ON r.q = x.q AND r.id = x.id")
def _(t):
    got = t("conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", (F.col("turn") % 3).alias("id")))), lambda x: x["id"]).alias("found"))
    each = got.select(F.col("conv_id").alias("q"), "found", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])).alias("id"))
    return each.select("q", "id", F.nullif(F.array_position("found", F.col("id")), F.lit(0)).alias("rank"))


@query("joi16_marked_source", "SELECT c.conv_id, c.turn, s.turn AS source_turn FROM conversations c LEFT JOIN conversations s ON s.conv_id = c.conv_id AND s.turn = c.turn % 5")
def _(t):
    c = t("conversations")
    s = c.select("conv_id", F.col("turn").alias("source_turn"))
    return c.select("conv_id", "turn", (F.col("turn") % 5).alias("n")).join(s.withColumn("n", F.col("source_turn")), ["conv_id", "n"], "left").select("conv_id", "turn", "source_turn")


# -- reports

@query("agg02_by_source", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def _(t): return t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("agg04_iso", "SELECT count(*) FILTER (event_type = 'view') AS access, count(*) FILTER (event_type IN ('purchase', 'signup')) AS changes, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'error' AND value > 50) AS serious FROM events")
def _(t): return t("events").agg(*[F.count_if(F.expr(c)).alias(n) for n, c in (("access", "event_type = 'view'"), ("changes", "event_type in ('purchase', 'signup')"), ("failures", "event_type = 'error'"), ("serious", "event_type = 'error' and value > 50"))])


@query("agg05_risk", "SELECT user_id, count(*) AS n, CASE WHEN count(*) > 100 THEN 'high' WHEN count(*) > 50 THEN 'medium' ELSE 'low' END AS risk FROM events WHERE event_type = 'error' GROUP BY user_id")
def _(t): return t("events").where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("risk", F.when(F.col("n") > 100, "high").when(F.col("n") > 50, "medium").otherwise("low"))


@query("agg06_modes", "SELECT user_id, event_type, count(*) AS n, count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS old FROM events GROUP BY user_id, event_type")
def _(t): return t("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("ts < timestamp_ntz'2024-01-15'")).alias("old"))


@query("agg12_query_stats", "SELECT count(*) AS n, round(avg(value), 4) AS mean, max(value) AS most, round(sum(value), 2) AS total FROM events")
def _(t): return t("events").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value"), 4).alias("mean"), F.max("value").alias("most"), r(F.sum("value"), 2).alias("total"))


@query("agg14_by_user", "SELECT user_id, count(*) AS n, round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS success, round(avg(value) FILTER (event_type <> 'error'), 4) AS mean_good FROM events GROUP BY user_id")
def _(t): return t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), r(F.count_if(F.expr("event_type <> 'error'")) / F.count(F.lit(1))).alias("success"), r(F.avg(F.expr("case when event_type <> 'error' then value end")), 4).alias("mean_good"))


@query("agg15_health", "WITH l AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) SELECT (SELECT round(count(*) FILTER (event_type <> 'error') / count(*), 6) FROM events) AS success, round(avg(value), 4) AS recent_mean, CASE WHEN (SELECT count(*) FILTER (event_type <> 'error') / count(*) FROM events) > 0.95 AND avg(value) < 5000 THEN 'healthy' ELSE 'degraded' END AS status FROM l")
def _(t):
    rate = t("events").agg((F.count_if(F.expr("event_type <> 'error'")) / F.count(F.lit(1))).alias("s"))
    last = t("events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).agg(F.avg("value").alias("m"))
    return rate.join(last).select(r("s").alias("success"), r("m", 4).alias("recent_mean"), F.when((F.col("s") > 0.95) & (F.col("m") < 5000), "healthy").otherwise("degraded").alias("status"))


@query("agg16_times", "SELECT event_type, min(value) AS least, max(value) AS most, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def _(t):
    ends = t("events").groupBy("event_type").agg(F.min("value").alias("least"), F.max("value").alias("most"), r(F.avg("value"), 4).alias("mean"))
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    return percentiles.percentiles(t("events"), "event_type", "value", shares).select("event_type", *[r(F.col(n)).alias(n) for n in shares]).join(ends.withColumnRenamed("event_type", "t"), F.col("event_type").eqNullSafe(F.col("t"))).drop("t")


@query("agg19_quartiles", "WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (k = n // 4) AS q1, max(value) FILTER (k = 3 * n // 4) AS q3 FROM s GROUP BY event_type")
def _(t): return percentiles.values_at(t("events"), "event_type", "value", {"q1": "n div 4", "q3": "3 * n div 4"})


_EVAL = "(SELECT conv_id AS q, min(CASE WHEN turn % 4 = 2 THEN turn + 1 END) AS rank, count(*) * 10.0::DOUBLE AS ms FROM conversations GROUP BY conv_id)"


@query("agg20_evaluation", f"SELECT count(*) AS queries, round(count(*) FILTER (rank <= 3) / count(*), 6) AS hit3, round(count(*) FILTER (rank <= 5) / count(*), 6) AS hit5, round(count(*) FILTER (rank <= 8) / count(*), 6) AS hit8, round(count(rank) / count(*), 6) AS recall, round(avg(ms), 4) AS mean_ms, round(quantile_cont(ms, 0.5), 4) AS p50_ms, round(quantile_cont(ms, 0.95), 4) AS p95_ms, count(*) FILTER (rank IS NULL) AS failures FROM {_EVAL}")
def _(t):
    judged = t("conversations").groupBy("conv_id").agg(F.min(F.expr("case when turn % 4 = 2 then turn + 1 end")).alias("rank"), (F.count(F.lit(1)) * 10.0).alias("ms"))
    return search.evaluation(judged, "rank", "ms")


@query("agg21_precision", "WITH g AS (SELECT conv_id, count(*) FILTER (turn < 10 AND turn % 3 = 0) AS hits, least(10, count(*)) AS n FROM conversations GROUP BY conv_id) SELECT round(avg(hits / n), 6) AS precision_10 FROM g")
def _(t): return t("conversations").groupBy("conv_id").agg(F.count_if(F.expr("turn < 10 and turn % 3 = 0")).alias("hits"), F.least(F.lit(10), F.count(F.lit(1))).alias("n")).agg(r(F.avg(F.col("hits") / F.col("n"))).alias("precision_10"))


@query("agg22_outcomes", "WITH s AS (SELECT event_type, sum(value) * CASE WHEN event_type = 'purchase' THEN 1.2::DOUBLE WHEN event_type = 'error' THEN 0.8::DOUBLE ELSE 1 END AS w FROM events GROUP BY event_type) SELECT event_type, round(w / sum(w) OVER (), 6) AS chance FROM s")
def _(t):
    w = t("events").groupBy("event_type").agg((F.sum("value") * F.expr("case when event_type = 'purchase' then 1.2D when event_type = 'error' then 0.8D else 1D end")).alias("w"))
    return w.join(w.agg(F.sum("w").alias("all"))).select("event_type", r(F.col("w") / F.col("all")).alias("chance"))


@query("agg24_confidence", "SELECT event_type, round(greatest(0.3, least(0.95, 0.4 * least(count(*) / 3000.0::DOUBLE, 1) + 0.4 * avg(value) / 200 + 0.2 * (max(value) / 1000 - 0.33) / 0.67)), 6) AS confidence FROM events GROUP BY event_type")
def _(t): return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.max("value").alias("x")).select("event_type", r(F.expr("greatest(0.3D, least(0.95D, 0.4D * least(n / 3000D, 1D) + 0.4D * m / 200 + 0.2D * (x / 1000 - 0.33D) / 0.67D))")).alias("confidence"))


@query("agg27_tags", "SELECT tag, count(*) AS n FROM (SELECT unnest([source, lang]) AS tag FROM documents) WHERE tag IS NOT NULL GROUP BY tag ORDER BY n DESC, tag LIMIT 5")
def _(t): return t("documents").select(F.explode(F.array("source", "lang")).alias("tag")).where("tag is not null").groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(5)


@query("agg29_endpoints", "SELECT event_type || ':' || CAST(user_id % 5 AS VARCHAR) AS k, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def _(t): return t("events").groupBy(F.expr("concat(event_type, ':', user_id % 5)").alias("k")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("value"), 4).alias("mean"))


@query("agg30_chunks", "SELECT count(*) AS n, round(avg(length(text) // 4), 4) AS mean, max(length(text) // 4) AS most, min(length(text) // 4) AS least, count(*) FILTER (length(text) // 4 > 800) AS oversized, array_to_string(list_sort(list(DISTINCT source)), ',') AS kinds FROM documents")
def _(t):
    n = F.expr("length(text) div 4")
    return t("documents").agg(F.count(F.lit(1)).alias("n"), r(F.avg(n), 4).alias("mean"), F.max(n).alias("most"), F.min(n).alias("least"), F.count_if(n > 800).alias("oversized"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("kinds"))


@query("agg33_fields", "SELECT k, count(*) AS n, count(*) > 100 AS common FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k")
def _(t): return t("events").select(F.explode(F.json_object_keys("props")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("common", F.col("n") > 100)


@query("agg35_verification", "SELECT role, count(*) AS n, round(count(*) FILTER (turn % 3 = 0) / count(*), 6) AS rate, round(avg(length(coalesce(text, ''))), 4) AS mean FROM conversations GROUP BY role")
def _(t): return t("conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), r(F.count_if(F.expr("turn % 3 = 0")) / F.count(F.lit(1))).alias("rate"), r(F.avg(F.length(F.coalesce("text", F.lit("")))), 4).alias("mean"))


@query("agg37_unread", "SELECT conv_id, count(*) FILTER (role = 'user' AND turn > 1) AS unread FROM conversations GROUP BY conv_id")
def _(t): return t("conversations").groupBy("conv_id").agg(F.count_if(F.expr("role = 'user' and turn > 1")).alias("unread"))


@query("agg39_coverage", "SELECT k AS keyword, count(*) FILTER (contains(lower(text), k)) AS n FROM conversations, (SELECT unnest(['the', 'ion', 'zz']) AS k) GROUP BY k")
def _(t): return t("conversations").select(F.explode(F.transform(F.array(*[F.lit(k) for k in ("the", "ion", "zz")]), lambda k: F.struct(k.alias("keyword"), F.contains(F.lower("text"), k).alias("has")))).alias("x")).groupBy("x.keyword").agg(F.count_if("x.has").alias("n"))


# -- windows, tops, sets

@query("win06_pairs_in_budget", "WITH p AS (SELECT conv_id, turn, sum(length(coalesce(text, '')) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS running FROM conversations) SELECT conv_id, turn FROM p WHERE running <= 200")
def _(t): return tables.within_budget(t("conversations"), "conv_id", [F.desc("turn")], F.expr("length(coalesce(text, '')) div 4"), 200).select("conv_id", "turn")


@query("win08_last_interactions", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10")
def _(t): return t("events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("n <= 10").select("event_id")


@query("win09_points", "SELECT event_id FROM (SELECT event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 5) ORDER BY ts DESC, event_id DESC LIMIT 20")
def _(t): return t("events").withColumn("n", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))).where("n <= 5").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id")


@query("win10_order", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations")
def _(t): return t("conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("nth"))


@query("win11_best", "SELECT arg_max(doc_id, n_chars * 1000000 - doc_id) AS doc_id FROM documents GROUP BY sha256(coalesce(text, ''))")
def _(t): return tables.first_seen(t("documents").withColumns({"h": F.sha2(F.coalesce("text", F.lit("")), 256), "o": -F.col("n_chars")}), ["h"], "o", "doc_id").select("doc_id")


@query("win12_prune", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(0.7::DOUBLE * (value / 100) + 0.3::DOUBLE * (1 - date_diff('day', CAST(ts AS DATE), DATE '2024-06-01') / 365.0::DOUBLE), 9) DESC, event_id) <= 3")
def _(t):
    score = F.round(F.expr("0.7D * (value / 100) + 0.3D * (1 - datediff(date'2024-06-01', cast(ts as date)) / 365D)"), 9)
    return t("events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(score), "event_id"))).where("n <= 3").select("event_id")


@query("top02_by_score", "SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 15")
def _(t): return t("documents").orderBy(F.desc("n_chars"), "doc_id").limit(15).select("doc_id")


@query("top03_oversample", "WITH c AS (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30) SELECT doc_id FROM c ORDER BY doc_id * 7919 % 1000 DESC, doc_id LIMIT 10")
def _(t): return t("documents").orderBy(F.desc("n_chars"), "doc_id").limit(30).orderBy(F.desc(F.expr("doc_id * 7919 % 1000")), "doc_id").limit(10).select("doc_id")


@query("top04_by_expression", f"SELECT doc_id FROM documents ORDER BY CASE {KIND} WHEN 'statute' THEN 10 WHEN 'case_law' THEN 5 ELSE 0 END + doc_id % 100 DESC, doc_id LIMIT 25")
def _(t): return t("documents").orderBy(F.desc(F.expr(f"case {KIND} when 'statute' then 10 when 'case_law' then 5 else 0 end + doc_id % 100")), "doc_id").limit(25).select("doc_id")


@query("top07_natural", "SELECT s FROM (SELECT DISTINCT CAST(doc_id % 300 AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE '' END AS s FROM documents) ORDER BY CAST(regexp_extract(s, '^([0-9]+)', 1) AS INTEGER), s LIMIT 50")
def _(t):
    s = t("documents").select(F.expr("concat(doc_id % 300, case when doc_id % 2 = 0 then 'A' else '' end)").alias("s")).distinct()
    return s.orderBy(F.regexp_extract("s", "^([0-9]+)", 1).cast("int"), "s").limit(50)


@query("top09_cap_and_last", "WITH x AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(coalesce(text, '')) DESC, turn) AS n, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) SELECT conv_id, turn FROM x WHERE n <= 2 OR turn = last")
def _(t):
    w = Window.partitionBy("conv_id")
    x = t("conversations").withColumns({"n": F.row_number().over(w.orderBy(F.desc(F.length(F.coalesce("text", F.lit("")))), "turn")), "last": F.max("turn").over(w)})
    return x.where("n <= 2 or turn = last").select("conv_id", "turn")


@query("set02_ordered_union", "SELECT doc_id, min(rank) AS rank FROM (SELECT doc_id, 0 AS rank FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 1 FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 2 FROM documents) GROUP BY doc_id")
def _(t):
    parts = [t("labels").where("toxic = 1"), t("documents").where("lang = 'en'"), t("documents")]
    every = [p.select("doc_id", F.lit(k).alias("rank")) for k, p in enumerate(parts)]
    return every[0].unionByName(every[1]).unionByName(every[2]).groupBy("doc_id").agg(F.min("rank").alias("rank"))


@query("set03_concat", "SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM documents")
def _(t): return t("labels").select("doc_id").unionByName(t("documents").select("doc_id"))


@query("set06_distinct", "SELECT DISTINCT lang, source FROM documents")
def _(t): return t("documents").select("lang", "source").distinct()


# -- arrays, maps, json

@query("arr01_unique", "SELECT conv_id, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM conversations GROUP BY conv_id")
def _(t): return t("conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


@query("arr02_tail", "SELECT doc_id, array_to_string(regexp_extract_all(text, '[a-zA-Z]+')[-3:], ' ') AS tail FROM documents WHERE len(regexp_extract_all(text, '[a-zA-Z]+')) >= 3")
def _(t): return t("documents").withColumn("w", F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0))).where("size(w) >= 3").select("doc_id", F.array_join(F.slice("w", -3, 3), " ").alias("tail"))


@query("jsn02_lists", "SELECT doc_id, '[' || string_agg('\"' || w || '\"', ',' ORDER BY i) || ']' AS js FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+')[:3]) AS w, unnest(range(1, least(3, len(regexp_extract_all(text, '[a-z]+'))) + 1)) AS i FROM documents) GROUP BY doc_id")
def _(t): return t("documents").select("doc_id", F.slice(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)), 1, 3).alias("w")).where("size(w) > 0").select("doc_id", F.to_json("w").alias("js"))


@query("jsn03_valid", "SELECT event_id, length(props) <= 1000 AND json_valid(props) AND len(json_keys(props)) <= 10 AS ok FROM events")
def _(t): return t("events").select("event_id", ((F.length("props") <= 1000) & F.try_parse_json("props").isNotNull() & (F.size(F.json_object_keys("props")) <= 10)).alias("ok"))


@query("map01_default", "SELECT event_id, coalesce(json_extract_string(props, '$.missing'), 'none') AS v FROM events")
def _(t): return t("events").select("event_id", F.coalesce(F.try_element_at(F.from_json("props", "map<string,string>"), F.lit("missing")), F.lit("none")).alias("v"))


@query("mth05_cost", "SELECT e.event_id, round(e.value * p.price, 6) AS cost FROM events e JOIN (SELECT unnest(['view', 'click', 'error', 'signup', 'purchase']) AS k, unnest([1.0::DOUBLE, 2.0, 0.0, 3.5, 4.25]) AS price) p ON p.k = e.event_type")
def _(t):
    prices = F.create_map(*[F.lit(x) for kv in {"view": 1.0, "click": 2.0, "error": 0.0, "signup": 3.5, "purchase": 4.25}.items() for x in kv])
    return t("events").select("event_id", r(F.col("value") * prices[F.col("event_type")]).alias("cost"))


# -- fusion

_FLAGS = {
    "apex": "source = 'src0'",
    "topics": "CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'ion') THEN 1 ELSE 0 END",
    "bridged": "HAS(text, '[0-9]')",
    "resolver": "CASE source WHEN 'src1' THEN 'party' WHEN 'src2' THEN 'party_or' WHEN 'src3' THEN 'fallback' END",
    "kw": "round(LEN(regexp_extract_all(lower(text), '(the|and|que)', 0)) * 3.0 / greatest(length(text), 1), 9)",
}
_LEGS = f"""(SELECT doc_id, source, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS vec, CAST(o_orderdate AS DATE) AS day, {", ".join(f"{R.duck(e)} AS {n}" for n, e in _FLAGS.items())}
    FROM documents JOIN embeddings e ON e.vec_id = doc_id JOIN embeddings q ON q.vec_id = 7 LEFT JOIN orders ON o_orderkey = doc_id)"""


def _legs(t) -> DataFrame:
    """Documents with an embedding: how close it is to the seventh, how common their words are, the day of the order with their id, and what their texts and sources tell."""
    q = t("embeddings").where("vec_id = 7").select(F.col("embedding").alias("q"))
    near = t("embeddings").join(F.broadcast(q)).select(F.col("vec_id").alias("doc_id"), r(search.cosine(F.col("embedding"), F.col("q")), 9).alias("vec"))
    days = t("orders").select(F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("day"))
    return t("documents").join(near, "doc_id").join(days, "doc_id", "left").select("doc_id", "source", "vec", "day", *[R.column(e).alias(n) for n, e in _FLAGS.items()])


_VEC = f"(SELECT * FROM {_LEGS} ORDER BY vec DESC, doc_id LIMIT 60)"
_KW = f"(SELECT * FROM {_LEGS} ORDER BY kw DESC, doc_id LIMIT 60)"


@query("rnk19_statute_fusion", f"""WITH v AS {_VEC}, k AS {_KW}, m AS (SELECT coalesce(v.doc_id, k.doc_id) AS doc_id, coalesce(v.vec, 0) / (SELECT max(vec) FROM v) AS vec_norm, coalesce(k.kw, 0) / (SELECT max(kw) FROM k) AS kw_norm, date_diff('day', coalesce(v.day, k.day), DATE '2005-01-01') AS age, coalesce(v.topics, k.topics) AS topics, coalesce(v.bridged, k.bridged) AS bridged, coalesce(v.apex, k.apex) AS apex FROM v FULL JOIN k ON v.doc_id = k.doc_id),
    s AS (SELECT *, 'statute' AS kind, 1 AS day, CASE WHEN topics > 1 THEN 1.1::DOUBLE ELSE 1.0 END AS authority, bridged AS section_guessed, apex AS id_guessed FROM m), w AS (SELECT *, {R.duck(R.RECENCY)} AS recency FROM s)
    SELECT doc_id, round({R.duck(R.STATUTE_SCORE)}, 6) AS score FROM w""")
def _(t):
    both = search.candidates(_legs(t), "doc_id", "vec", "kw", 60)
    made = both.withColumns({"kind": F.lit("statute"), "age": F.datediff(F.lit("2005-01-01").cast("date"), "day"), "authority": F.when(F.col("topics") > 1, 1.1).otherwise(1.0), "section_guessed": F.col("bridged"), "id_guessed": F.col("apex")}).withColumn("day", F.lit(1))
    return made.withColumn("recency", R.column(R.RECENCY)).select("doc_id", r(R.column(R.STATUTE_SCORE)).alias("score"))


@query("rnk18_case_fusion", f"""WITH v AS (SELECT *, row_number() OVER (ORDER BY vec DESC, doc_id) AS r FROM {_VEC}), k AS (SELECT *, row_number() OVER (ORDER BY kw DESC, doc_id) AS r FROM {_KW}),
    m AS (SELECT coalesce(v.doc_id, k.doc_id) AS doc_id, 1.0::DOUBLE / (60 + coalesce(v.r, 1000000)) + 1.0::DOUBLE / (60 + coalesce(k.r, 1000000)) AS rrf, coalesce(v.vec, 0) / (SELECT max(vec) FROM v) AS vec_norm, 2005 - year(coalesce(v.day, k.day)) AS years, coalesce(v.topics, k.topics) AS topics, coalesce(v.bridged, k.bridged) AS bridged, coalesce(v.apex, k.apex) AS apex, coalesce(v.resolver, k.resolver) AS resolver FROM v FULL JOIN k ON v.doc_id = k.doc_id)
    SELECT doc_id, round({R.duck(R.CASE_SCORE)}, 6) AS score FROM m""")
def _(t):
    both = search.candidates(_legs(t), "doc_id", "vec", "kw", 60)
    made = both.withColumn("years", 2005 - F.year("day"))
    return made.select("doc_id", r(R.column(R.CASE_SCORE)).alias("score"))


@query("rnk22_diverse_top", f"WITH c AS (SELECT doc_id, source, vec AS score, bridged AS exempt FROM {_LEGS} ORDER BY score DESC, doc_id LIMIT 200), n AS (SELECT *, NOT exempt AND row_number() OVER (PARTITION BY source, exempt ORDER BY score DESC, doc_id) > 1 AS again FROM c) SELECT doc_id FROM n ORDER BY round(0.7 * score - CASE WHEN again THEN 0.3 ELSE 0 END, 9) DESC, score DESC, doc_id LIMIT 20")
def _(t):
    some = _legs(t).select("doc_id", "source", F.col("vec").alias("score"), F.col("bridged").alias("exempt")).orderBy(F.desc("score"), "doc_id").limit(200)
    return search.diverse_top(some, "source", "score", "doc_id", "exempt", 20).select("doc_id")


@query("rnk32_position_score", "SELECT doc_id, round(1.0::DOUBLE - (row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) * 0.1::DOUBLE, 6) AS score FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10)")
def _(t):
    top = t("documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)
    return search.ranked(top, "n_chars", "doc_id", "nth").select("doc_id", r(1.0 - (F.col("nth") - 1) * 0.1).alias("score"))
