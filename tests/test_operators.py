"""Small fixtures against brute force, and the cases that the tables lack."""

from __future__ import annotations

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from ferrule.functions import temporal, text
from ferrule.operators import chunks, percentiles, search, tables
from ferrule.sources import files
from ferrule.streaming import windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_intervals_are_half_open(spark):
    d = lambda s: F.lit(s).cast("date")
    assert one(spark, temporal.valid_on(d("2020-01-01"), d("2021-01-01"), d("2020-01-01")))
    assert not one(spark, temporal.valid_on(d("2020-01-01"), d("2021-01-01"), d("2021-01-01")))
    assert one(spark, temporal.valid_on(d(None), d(None), d("1900-01-01")))
    assert one(spark, temporal.decided_by(d(None), d("2020-01-01"), unknown=True))
    assert not one(spark, temporal.decided_by(d(None), d("2020-01-01"), unknown=False))


def test_query_date_forms(spark):
    f = lambda s: one(spark, temporal.query_date(F.lit(s)))
    assert f("law on 05/03/2019") == dt.date(2019, 3, 5)
    assert f("as of 7 March 2011 and 2015") == dt.date(2011, 3, 7)
    assert f("in 1999") == dt.date(1999, 12, 31)
    assert f("none here") is None and f(None) is None


def packed(text, most):
    """The chunks by a plain loop: pieces join while the two lengths together don't pass `most`."""
    done, cur = [], ""
    for s in re.split(r"(?<=[.!?])\s+", text):
        if len(cur) + len(s) > most and not cur:
            for w in s.split():
                if len(cur) + len(w) <= most:
                    cur = f"{cur} {w}" if cur else w
                elif cur:
                    done, cur = [*done, cur.strip()], w
                else:
                    done.append(w)
        elif len(cur) + len(s) > most:
            done, cur = [*done, cur.strip()], s
        else:
            cur = f"{cur} {s}" if cur else s
    return [*done, cur.strip()] if cur else done


def test_sentence_chunks_by_a_plain_loop(spark):
    texts = ["One two. Three four! Five? " * 60, "", "no end " * 50 + "now. Short one. " * 9, "x" * 150 + " y. z.", "A. " + "b" * 130 + ". C."]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "id long, text string")
    rows = sorted((r.id, r.chunk, r.text) for r in chunks.sentence_chunks(docs, "id", "text", most=100).collect())
    assert rows == [(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(packed(t, 100))]


def test_batch_of_queries_in_blocks(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = df.where("vec_id % 5 = 0").toDF("q_id", "q")
    once, blocks = (sorted((r.q_id, r["rank"], r.vec_id) for r in search.nearest_each(df, q, 3, block).collect()) for block in (1000, 3))
    assert once == blocks and len(once) == 30


def test_values_at_places(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (3, 1, 1, 2, 9, 9, 9)] + [("b", 5.0)], "g string, v double")
    got = {r.g: (r.q1, r.q3) for r in percentiles.values_at(df, "g", "v", {"q1": "n div 4", "q3": "3 * n div 4"}).collect()}
    assert got == {"a": (1.0, 9.0), "b": (5.0, 5.0)}


def pieces(spark, cut, text, **how):
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    rows = sorted(cut(docs, "id", "text", **how).collect())
    assert all(r.id == 1 for r in rows)
    return [r.text for r in rows]


def test_paragraph_windows_cover_every_paragraph(spark):
    paragraphs = [f"paragraph {i} " + "word " * (20 * (i % 7) + 5) for i in range(40)]
    made = pieces(spark, chunks.paragraph_windows, "\n\n".join(paragraphs))
    assert all(any(p.strip() in c for c in made) for p in paragraphs)
    assert all(80 <= len(c) // 4 <= 800 for c in made)


def test_paragraph_windows_split_what_is_long(spark):
    sentences = [f"sentence {i} " + "word " * 60 + "end." for i in range(30)]
    made = pieces(spark, chunks.paragraph_windows, "a short one of more than twenty\n \n" + " ".join(sentences) + "\n\n" + "x" * 9000 + "\n\ntiny")
    assert all(80 <= len(c) // 4 <= 800 for c in made)
    assert all(any(s in c for c in made) for s in sentences)
    assert sum(c.count("x") for c in made) == 9000  # no x elsewhere
    assert not any("tiny" in c for c in made)


def test_paragraph_windows_repeat_the_end(spark):
    first, second, third = "a" * 2000, "b" * 2000, "c" * 400
    assert pieces(spark, chunks.paragraph_windows, "too short\n\n") == []
    made = pieces(spark, chunks.paragraph_windows, "\n\n".join([first, second, third]))
    assert made == [first, "a" * 80 + "\n\n" + second, "b" * 320 + "\n\n" + third]


def test_other_chunkers(spark):
    said = [f"number {i} is said here." for i in range(9)]
    made = pieces(spark, chunks.overlapping_sentences, " ".join(said), most=20)
    assert made == [" ".join(said[i : i + 3]) for i in range(7)]
    assert pieces(spark, chunks.case_paragraphs, "one\n\n two \n\n\n\n" + "x" * 50 + "\n\nend", most=5) == ["one\n\ntwo", "x" * 50, "end"]
    long = "2. b" + "\nIllustration " + "y" * 40 + "\nProviso " + "z" * 40
    assert pieces(spark, chunks.statute_sections, "head\n1. a\n" + long, most=15) == ["head", "1. a", "2. b\n\nIllustration " + "y" * 40, "Proviso " + "z" * 40]


def test_judgment_sections(spark):
    facts, held = "FACTS: " + "the man went home. " * 10, "facts : " + "1. " + "w " * 60 + "2. " + "v " * 60
    made = pieces(spark, chunks.judgment_sections, "short " + facts + held, most=200)
    assert made[0] == facts.strip()
    assert made[1].startswith("facts : ") and "2. v" in made[-1]
    assert pieces(spark, chunks.judgment_sections, "no heading here at all. " * 6, most=70, overlap=0) == [" ".join(["no heading here at all"] * 3)] + ["no heading here at all no heading here at all no heading here at all."]
    assert pieces(spark, chunks.judgment_sections, "too short") == []


def test_parsed_lines(spark):
    docs = spark.createDataFrame([(1, "lost\n1. Theft.— of it\nWhoever\n\nIllustration A\nmore\nProvided that\n2A. Bail — y\nx"), (2, None)], "id long, text string")
    rows = [tuple(r) for r in chunks.parsed_lines(docs, "id", "text").orderBy("section", "unit").collect()]
    assert rows == [(1, 1, "1", 0, "Section", "1. Theft.— of it\nWhoever"), (1, 1, None, 1, "Illustration", "Illustration A\nmore"), (1, 1, None, 2, "Proviso", "Provided that"), (1, 2, "2A", 0, "Section", "2A. Bail — y\nx")]


def test_nearest_is_exact(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = [1.0, 2.0, 0.5]
    cos = lambda v: sum(a * b for a, b in zip(v, q, strict=True)) / (sum(a * a for a in v) ** 0.5 * sum(b * b for b in q) ** 0.5)
    want = [i for i, v in sorted(rows, key=lambda r: (-round(cos(r[1]), 12), r[0]))][:5]
    got = [r.vec_id for r in search.nearest(df, q, 5, "vec_id").withColumn("s", F.round("sim", 12)).orderBy(F.desc("s"), "vec_id").collect()]
    assert got == want


def test_zero_vector_has_no_cosine(spark):
    assert one(spark, search.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_interval_and_as_of_joins(spark):
    d = dt.date
    spans = spark.createDataFrame([("a", d(2000, 1, 1), d(2003, 6, 1)), ("b", d(1999, 1, 1), d(1999, 1, 2))], "n string, s date, e date")
    points = spark.createDataFrame([(1, d(2000, 1, 1)), (2, d(2003, 6, 1)), (3, d(1999, 1, 1)), (4, d(2002, 12, 31))], "p long, day date")
    both = tables.interval_join(points.withColumn("k", F.lit(1)), spans.withColumn("k", F.lit(1)), "day", "s", "e", ["k"])
    assert sorted((r.p, r.n) for r in both.collect()) == [(1, "a"), (3, "b"), (4, "a")]
    left = spark.createDataFrame([("u", 5), ("u", 1), ("w", 9)], "k string, t long")
    right = spark.createDataFrame([("u", 2, 20.0), ("u", 5, 50.0)], "k string, t long, v double")
    assert sorted((r.k, r.t, r.v) for r in tables.as_of(left, right, "k", "t", "v").collect() if r.v) == [("u", 5, 50.0)]


def test_upsert_and_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (4, "d")], "id long, v string")
    assert sorted((r.id, r.v) for r in tables.upsert(old, new, ["id"]).collect() if r.v) == [(1, "a"), (2, "c"), (4, "d")]
    got = {r.id: r.action for r in tables.changes(old, tables.upsert(old, new, ["id"]), "id", ["v"]).collect()}
    assert got == {2: "UPDATE", 4: "INSERT"}


def test_runs_and_percentile(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([5, 9, 9, 1, 9])], "k string, t long, v long")
    assert [r.n for r in tables.runs(df, "k", ["t"], F.col("v") > 5).groupBy("run").agg(F.count("*").alias("n")).orderBy("run").collect()] == [2, 1]
    assert tables.percentile_floor(df, "k", "v", 50).first().value == 9


def test_text_functions_take_null_and_empty(spark):
    for f in (text.tokens, text.content_hash, text.tidy, text.sentences, text.slug, text.noise_confidence):
        assert one(spark, f(F.lit(None).cast("string"))) in (None, 0.0)
        one(spark, f(F.lit("")))
    assert one(spark, text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    assert one(spark, text.is_email(F.lit("a@b.org"))) and not one(spark, text.is_email(F.lit("a@b")))


def test_jsonl_and_file_listing(spark, tmp_path):
    files.write_jsonl(spark.createDataFrame([(1, "x"), (2, None)], "id long, v string"), str(tmp_path / "out"))
    back = files.read_jsonl(spark, str(tmp_path / "out"), "id long, v string")
    assert sorted(r.id for r in back.collect()) == [1, 2]
    assert files.list_files(spark, str(tmp_path / "out"), "*.json").count() >= 1


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(i, i % 3, "click", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=20 * i), float(i)) for i in range(200)]
    schema = "event_id long, user_id long, event_type string, ts timestamp, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "events"))
    source = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "events"))
    batch = spark.read.schema(schema).parquet(str(tmp_path / "events"))

    def drain(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(map(tuple, spark.table(name).collect()))

    assert drain(windows.windowed_stats(source(), "5 minutes"), "complete", "stats") == sorted(map(tuple, windows.windowed_stats(batch, "5 minutes").collect()))
    got = drain(windows.admit(source(), 3, 120), "append", "admitted")
    assert got == sorted(map(tuple, windows.admit(batch, 3, 120).collect()))
    assert len(drain(windows.first_arrivals(source(), "user_id"), "append", "firsts")) == 3


def test_similar_documents_by_brute_force(spark, tmp_path):
    import random
    import re

    from ferrule.plans.queries import QUERIES

    rng = random.Random(4)
    rows = [(900, None), (901, ""), (902, "one"), (903, "ONE one")]
    for g in range(30):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 10, 40]))]
        rows += [(4 * g + c, " ".join([*base[: len(base) - c * len(base) // 20], *[f"n{g}{c}{i}" for i in range(c * len(base) // 20)]])) for c in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sets = {i: set(re.findall("[a-z0-9]+", (t or "").lower())) for i, t in rows}
    want = {(a, b): (len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(want) > 30
    got = QUERIES["cmp01_documents"](spark, str(tmp_path)).collect()
    assert sorted((q.x, q.y, q.sim) for q in got) == sorted((a, b, round(s / n, 6)) for (a, b), (s, n) in want.items())
    got = QUERIES["joi11_document_pairs"](spark, str(tmp_path)).collect()
    assert sorted((q.x, q.y, q.shared) for q in got) == sorted((a, b, s) for (a, b), (s, _) in want.items())


def test_near_lines_greedily(spark):
    base = [f"w{i}" for i in range(40)]
    shift = lambda n: " ".join(base[n:] + [f"x{i}" for i in range(n)])  # noqa: E731  each step away from base keeps less of it
    docs = {1: [shift(0), shift(1), shift(0).upper(), "", shift(2), "alone here", "here alone", shift(1)], 2: [shift(0)], 3: [shift(3), shift(2), shift(1), shift(0)], None: ["a b"]}
    df = spark.createDataFrame([(k, "\n".join(v)) for k, v in docs.items() if k] + [(4, None)], "doc_id long, text string")
    want = set()
    for k, lines in docs.items():
        held: list[set] = []
        for i, line in enumerate(lines if k else []):
            words = set(line.lower().split())
            kept = not words or not any(100 * len(words & h) >= 90 * len(words | h) for h in held)
            if kept and words:
                held.append(words)
            want.add((k, i, kept))
    got = {tuple(x) for x in chunks.near_in_document(df, "doc_id", "text", 90).collect()}
    assert got == want and any(not kept for *_, kept in want)


def requests(spark):
    rows = [(u, at * 7 % 211 + (at // 9) * 5, at) for u in (1, 2) for at in range(120 * u)] + [(3, 5, 900), (3, 5, 901), (3, 5, 902)]
    return rows, spark.createDataFrame(rows, "user_id long, at long, event_id long")


def test_token_bucket(spark):
    rows, df = requests(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # the state goes across batches
    try:
        got = {(x.user_id, x.event_id): x.admitted for x in windows.spend(df, 10, 3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held: dict[int, float] = {}
    last: dict[int, int] = {}
    for u, at, e in sorted(rows):
        held[u] = min(30, held.get(u, 30) + at - last.get(u, at))
        last[u] = at
        assert got[u, e] == (held[u] >= 10)
        held[u] -= 10 * (held[u] >= 10)
    assert len(got) == len(rows) and len(set(got.values())) == 2


def test_both_request_limits(spark):
    rows, df = requests(spark)
    got = {(x.user_id, x.event_id): x.admitted for x in windows.limit_requests(df, 2, 15, 10, 1).collect()}
    past, bucket, last = {}, {}, {}
    for u, at, e in sorted(rows):
        past[u] = [x for x in past.get(u, []) if x > at - 15]
        bucket[u] = min(10, bucket.get(u, 10) + at - last.get(u, at))
        last[u] = at
        passed = False
        if len(past[u]) < 2:
            past[u].append(at)
            if bucket[u] >= 10:
                bucket[u] -= 10
                passed = True
        assert got[u, e] == passed
    assert len(got) == len(rows)


def test_carried_on_empty_and_ungrouped(spark):
    step = lambda n, row: (n + 1, n == 0)  # noqa: E731  the first of each group
    empty = spark.createDataFrame([], "g long, v long")
    assert tables.carried(empty, ["v"], 0, step, "first").collect() == []
    alone = spark.createDataFrame([(None, 1), (None, 2), (1, 1), (1, 2)], "g long, v long")
    assert sorted((x.g or 0, x.v, x.first) for x in tables.carried(alone, ["v"], 0, step, "first").collect()) == [(0, 1, True), (0, 2, True), (1, 1, True), (1, 2, False)]


def _inside(points, spans):
    return sorted((p, s) for p, k, x in points for s, q, a, b in spans if k is not None and k == q and x is not None and (a is None or x >= a) and (b is None or x < b))


@pytest.mark.parametrize("kind", ["date", "bigint", "timestamp"])
def test_interval_join_with_open_ends(spark, kind):
    rng = random.Random(kind)
    base = dt.datetime(2019, 1, 1)

    def value(n):
        return None if n is None else n if kind == "bigint" else base + dt.timedelta(seconds=n * 0.4) if kind == "timestamp" else (base + dt.timedelta(days=n)).date()

    some = lambda most: rng.choice([None, *[rng.randrange(-50, most) for _ in range(5)]])
    points = [(i, rng.choice([1, 2, None]), value(some(3000))) for i in range(300)]
    spans = []
    for i in range(120):
        a, n = some(3000), rng.choice([None, 0, 1, 2, 7, 64, 1000, 100_000])
        spans.append((i, rng.choice([1, 2, None]), value(a), value(None if n is None else (a or 0) + n)))
    spans += [(200, 1, None, None), (201, 2, value(5), value(5)), (202, 2, value(9), value(3)), (203, 1, value(-10**4), value(-9000))]
    p, s = spark.createDataFrame(points, f"p int, k int, x {kind}"), spark.createDataFrame(spans, f"s int, k int, a {kind}, b {kind}")
    assert sorted(tuple(r) for r in tables.interval_join(p, s, "x", "a", "b", ["k"]).select("p", "s").collect()) == _inside(points, spans)
    assert tables.interval_join(p.limit(0), s, "x", "a", "b", ["k"]).collect() == tables.interval_join(p, s.limit(0), "x", "a", "b", ["k"]).collect() == []


def test_interval_cells_are_few(spark):
    """A span of a million days makes no more rows than twice the logarithm of its length."""
    points = spark.range(0, 1_000_000, 1000).select("id", F.lit(1).alias("k"), F.col("id").alias("x"))
    spans = spark.createDataFrame([(1, 1, 3, 999_999), (2, 1, None, None)], "s int, k int, a long, b long")
    joined = tables.interval_join(points, spans, "x", "a", "b", ["k"])
    assert joined.count() == 1999


@pytest.mark.parametrize("small", [1, 7, 100_000])
def test_exact_percentiles(spark, small):
    rng = random.Random(small)
    groups = {"a": [rng.gauss(0, 1e6) for _ in range(501)], "b": [1.0] * 300 + [2.0], "c": [5.0], "d": [rng.choice([1e308, -1e308, 0.0, 1e-300]) for _ in range(90)], None: [float(i) for i in range(40)], "e": []}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.g: r for r in percentiles.percentiles(df, "g", "v", shares, small=small, bins=4).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs = sorted(vs)
        for name, share in shares.items():
            if not vs:
                assert got[g][name] is None
                continue
            at = (len(vs) - 1) * share
            a, b = vs[math.floor(at)], vs[math.ceil(at)]
            assert got[g][name] == (a if at == math.floor(at) else a + (b - a) * (at - math.floor(at)))
    assert percentiles.percentiles(df.limit(0), "g", "v", shares).collect() == []
