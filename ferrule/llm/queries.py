"""The operators' queries over the driver's tables, with production parameters, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.llm.packing import pack

    pieces = pack(_table(spark, sf_dir, "documents"), tokenizer_file(), added=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.llm.toxicity import fit, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.llm.mixing import draws, measure
    from ferrule.llm.staging import stage

    measured = measure(_table(spark, sf_dir, "documents")).select("doc_id", "source", "_size", "_key", "_s", F.monotonically_increasing_id().alias("_row"))
    drawn = draws(stage(measured, "measured"))
    one = [F.first(c).alias(n) for c, n in (("doc_id", "doc_id"), ("_size", "size"), ("_source_size", "source_size"), ("_target", "target"))]
    return drawn.groupBy("_row").agg(*one, F.sum("_words").alias("taken"), F.collect_set("_shard").alias("shards")).select("doc_id", "size", "source_size", "target", "taken", F.array_sort("shards").alias("shards"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.llm.language_id import fit, held_out, predict

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.llm.lm_score import score

    return score(_table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.llm.chat_format import digests, format_chats

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_chats(rows.unionByName(spark.sql("values (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)"))))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.llm.exact_dedup import decide

    return decide(_table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.llm.near_dup import decide

    return decide(_table(spark, sf_dir, "documents"), width=2, percent=80).drop("row_key")


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.llm.embedding_dup import find_links

    return find_links(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.llm.lexical import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.llm.repeats import repeats

    found = repeats(_table(spark, sf_dir, "documents"), length=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.llm.divergence import audit

    return audit(_table(spark, sf_dir, "documents"), least=30, k=50)


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.llm.url_filter import judge

    return judge(_table(spark, sf_dir, "pages").select("page_id", "url"), RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_language_id": op4_language_id,
    "op5_lm_score": op5_lm_score,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_minhash": op8_minhash,
    "op9_url_filter": op9_url_filter,
    "op10_embeddings": op10_embeddings,
    "op11_lexical_search": op11_lexical_search,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_source_divergence": op13_source_divergence,
    "pipeline": pipeline,
}

_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op6_chat_formatting": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        marked AS (
            SELECT *, len(regexp_extract_all(role, '<\\*\||<\\*/?s>|\[\\*/?INST\]|<\\*</?SYS>>'))
                    + len(regexp_extract_all(text, '<\\*\||<\\*/?s>|\[\\*/?INST\]|<\\*</?SYS>>')) AS controls,
                lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end FROM rows)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length(role) + length(text) + controls + length('<|turn|>' || '<|says|>' || '<|end|>') + 1) AS BIGINT) AS formatted_chars,
            bool_and((before || '>' || role) IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user'))
                AND bool_or(from_end = 1 AND role IN ('assistant', 'user')) AS valid
        FROM marked GROUP BY conv_id""",
    "op7_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_AZ.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op8_minhash": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 2 THEN [words[1]]
                ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingle FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id WHERE nb.n * 5 >= na.n * 4 AND na.n * 5 >= nb.n * 4
            GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.doc_id""",
    "op10_embeddings": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)), true)
                AND list_contains(list_transform(embedding, lambda x: x <> 0), true)),
        links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
        reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
        SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.x = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
        FROM embeddings e JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = e.vec_id""",
    "op9_url_filter": f"""
        WITH rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
                ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        parts AS (
            SELECT page_id, {_AZ.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')")} AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
        fits AS (
            SELECT p.page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
            FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.page_id)
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fits f USING (page_id)""",
    "op11_lexical_search": f"""
        WITH d AS (
            SELECT doc_id, unnest(regexp_extract_all({_AZ.format("text")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
        n AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id),
        c AS (SELECT count(*) AS docs, CAST(sum(n) AS HUGEINT) AS total FROM n),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS HUGEINT) AS w FROM tf, c GROUP BY term),
        m AS (SELECT doc_id, 20 * (100 - 50 + (50 * CAST(n AS HUGEINT) * docs) // total) AS m FROM n, c),
        q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all({_AZ.format("text")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
        s AS (
            SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * CAST(tf AS HUGEINT)) // (1000 * tf + m))) AS BIGINT) AS score
            FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY rank <= 50""",
    "op12_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 49)) AS i, h FROM d),
        g AS (SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS gram FROM w),
        late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS least FROM g) WHERE least < doc_id),
        runs AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
            FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM late)),
        spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run),
        kept AS (
            SELECT doc_id, sum(b - a) AS n, count(*) AS k, string_agg(substring(h, 2 * coalesce(p, 0) + 1, 2 * (a - coalesce(p, 0))), '' ORDER BY a) AS head, max(b) AS last
            FROM (SELECT s.*, lag(b) OVER (PARTITION BY doc_id ORDER BY a) AS p FROM spans s) JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans,
            sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op13_source_divergence": f"""
        WITH d AS (
            SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
        t AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
        kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
        groups AS (
            SELECT g.lang, g.source, coalesce(n, 0) + 5 * coalesce(v, 0) AS size FROM (SELECT DISTINCT lang, source FROM d) g
            LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source) USING (lang, source) LEFT JOIN v USING (lang)),
        langs AS (SELECT lang, sum(c) + 5 * any_value(v) AS size FROM c JOIN v USING (lang) GROUP BY lang),
        p AS (
            SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + 1000000000 * CAST(coalesce(c, 0) + 5 AS HUGEINT) // CAST(size AS HUGEINT) AS p
            FROM groups g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        q AS (SELECT lang, term, 1 + 1000000000 * CAST(sum(c) + 5 AS HUGEINT) // CAST(size AS HUGEINT) AS q FROM c JOIN langs USING (lang) GROUP BY lang, term, size),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        found AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
            UNION ALL SELECT p.lang, source, 'term', p.term, CAST(p - q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found QUALIFY part = 'pair' OR rank <= 50""",
}
