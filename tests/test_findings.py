"""What a reviewer found on larger tables and odd inputs, one test each."""

from __future__ import annotations


def test_boilerplate_keeps_digits_at_the_ends_of_lines(spark, same_as_sql, duck, tmp_path):
    from ferrule.plans import fuller

    rows = [(1, "44 of four. 4655932058657044"), (2, "20.118.157.107 is it\n  55 spaced  "), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    sql = fuller.ORACLE_SQL["str09_boilerplate_lines"].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    same_as_sql(fuller.QUERIES["str09_boilerplate_lines"](spark, str(tmp_path)), sql)


def test_similar_sets_meet_by_few_rows(spark, tmp_path):
    """Sets that share many words but aren't alike are ruled out inside the join: what follows it sees few pairs, and none that is alike is lost."""
    import random

    from ferrule.operators import tables

    rng = random.Random(8)
    rows = [(i, sorted({f"w{rng.randrange(60 + 90 * (i % 3))}" for _ in range(60)})) for i in range(300)]
    rows += [(1000 + i, sorted({*rows[i][1][3:], "new"})) for i in range(0, 300, 10)] + [(2000 + i, rows[i][1]) for i in range(40)] + [(3000, []), (3001, None)]
    sets = {k: set(s or ()) for k, s in rows}
    want = {(a, b): (len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows, "k long, s array<string>").repartition(5)
    for found in (tables.similar_pairs(df, "k", "s"), tables.similar_rows(df, "k", "s")):
        assert {(r.x, r.y): (r.shared, r.every) for r in found.collect()} == want
    plan = tables.similar_pairs(df, "k", "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in next(line for line in plan.splitlines() if "Join Inner" in line and "item" in line and "at_x" in line)


def test_chunkers_hold_few_texts(spark):
    from ferrule.operators import chunks

    df = spark.createDataFrame([(i, f"1. a\n2. b {i}") for i in range(100)] + [(100, None), (101, "")], "k long, t string")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = chunks.statute_sections(df, "k", "t")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= chunks.SENT
    assert sorted(map(tuple, rows.collect())) == sorted((i, c, t) for i in range(100) for c, t in enumerate(["1. a", f"2. b {i}"]))


def test_small_groups_of_spans_are_not_cut(spark):
    import random

    from ferrule.operators import tables

    rng = random.Random(5)
    points = [(rng.randrange(4), i, rng.randrange(1000)) for i in range(400)] + [(None, 400, 5), (0, 401, None)]
    spans = [(k, 1000 * k + i, rng.choice([None, a := rng.randrange(900)]), rng.choice([None, a + rng.randrange(1, 90)])) for k, n in enumerate((250, 3, 101, 0)) for i in range(n)] + [(None, 9999, None, None)]
    for kept in ({0, 1, 2, 3, None}, {1, 3, None}):
        s = [x for x in spans if x[0] in kept]
        joined = tables.interval_join(spark.createDataFrame(points, "k int, p int, x long"), spark.createDataFrame(s, "k int, s int, a long, b long"), "x", "a", "b", ["k"])
        want = sorted((p, q) for k, p, x in points for g, q, a, b in s if k is not None and k == g and x is not None and (a is None or x >= a) and (b is None or x < b))
        assert sorted(map(tuple, joined.select("p", "s").collect())) == want
    assert "explode" not in joined._jdf.queryExecution().optimizedPlan().toString().lower()


def test_nearest_of_odd_vectors_and_by_products(spark):
    """Zero, null, not finite and shorter vectors stand where the cosine puts them; equal ones by their ids; and no cosine is taken of rows that can't be near."""
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from ferrule.operators import search

    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[i % 7][1]) for i in range(40)] + [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [1.0, None] * 4), (404, [1.0] * 5), (405, []), (406, [float("inf")] * 8), (407, [1e200] * 8), (408, [3e-200] * 8)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    q = v.where("vec_id % 9 = 0 or vec_id >= 400").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    best = Window.partitionBy("q_id").orderBy(F.desc_nulls_last("sim"), "vec_id")
    every = v.crossJoin(F.broadcast(q)).withColumn("sim", search.cosine(F.col("embedding"), F.col("q"))).withColumn("rank", F.row_number().over(best))
    for k in (1, 6, 400):
        for block in (1000, 10):
            got = search.nearest_each(v, q, k, block).select("q_id", "rank", "vec_id").collect()
            assert sorted(map(tuple, got)) == sorted(map(tuple, every.where(F.col("rank") <= k).select("q_id", "rank", "vec_id").collect()))
    assert search._likely(v.where("vec_id < 300"), q.where("q_id < 300"), 5).count() < 300 * 34 / 2


def test_claims_are_told_from_sentences_trimmed_once(spark, tmp_path):
    import re

    from ferrule.functions import rules
    from ferrule.plans import further

    said = {"definitive": ["the act provides so", "as per the act it is", "high court ruled", "is valid under it", "shall be read according to it"], "case_law": ["in the case of x", "the court in x"], "statutory": ["section 3", "article 4", "under the x act"], "procedural": ["a procedure", "preprocess", "by petition"], "quantitative": ["9 days"]}
    for name, sentences in said.items():
        assert all(re.search(rules.CLAIMS[name], s) and any(w in s for w in rules.CLAIM_WORDS[name]) for s in sentences)
    spark.createDataFrame([(1, "x")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = further.QUERIES["ver02_claim_indicators"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan.split("Generate")[0] and "Generate" in plan


def test_sought_strings_are_few_in_what_is_shuffled(spark):
    from ferrule.operators import contained

    texts = spark.createDataFrame([(i, f"document number {i} says this and that, at some length, of {i * 7919} things") for i in range(200)], "doc_id long, text string")
    strings = spark.createDataFrame([("says this and that, at",), ("number 17 says this",), ("never there at all",), ("17",), (None,)], "quote string")
    got = {(r.quote, r.doc_id) for r in contained.contained(strings, texts, "quote", "doc_id", "text").collect()}
    want = {(q, r.doc_id) for r in texts.collect() for q in ("says this and that, at", "number 17 says this", "never there at all", "17") if q in r.text}
    assert got == want
    whole = texts.select(texts.doc_id.alias("tid"), "text")
    assert contained._seeded(whole, "tid", 16, False, contained._few(contained._seeded(strings.selectExpr("1L sid", "quote text"), "sid", 16, True))).count() < 1000 < contained._seeded(whole, "tid", 16, False).count()


def test_texts_that_differ_at_every_dozen_characters_are_alike(spark):
    """No two texts of the pair share a stretch of 12 characters; the ratio is above 0.85 all the same."""
    import random
    from difflib import SequenceMatcher

    from ferrule.operators import fuzzy

    rng = random.Random(4)
    a = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=190))
    b = "".join("!" if i % 10 == 5 else c for i, c in enumerate(a))
    other = ["".join(rng.choices("abcdefghij ", k=rng.choice([30, 190, 900]))) for _ in range(40)]
    rows = [(1, a), (2, b), *[(10 + i, t) for i, t in enumerate(other)], *[(100 + i, t[:-3] + "xyz") for i, t in enumerate(other)]]
    want = {(x, y) for x, s in rows for y, t in rows if x < y and SequenceMatcher(None, s.strip(), t.strip()).ratio() > 0.85}
    assert (1, 2) in want and len(want) > 20
    assert {(r.x, r.y) for r in fuzzy.alike(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()} == want
    texts = spark.createDataFrame(rows, "key long, text string")
    assert want <= {(r.x, r.y) for r in fuzzy.candidates(texts, 0.85).collect()}


def test_seeds_are_filtered_however_many_are_sought(spark, monkeypatch):
    import random

    from ferrule.operators import contained

    monkeypatch.setattr(contained, "SENT", 10)
    rng = random.Random(3)
    texts = [(i, "".join(rng.choices("abcdefgh ", k=400))) for i in range(60)]
    strings = [t[k : k + n] for _, t in texts[:30] for k, n in [(rng.randrange(0, 300), rng.choice([17, 40, 70, 100]))]] + ["never there, but long enough to be sought" * 3]
    df, s = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(x,) for x in strings], "quote string")
    got = {(r.quote, r.doc_id, r.place) for r in contained.contained(s, df, "quote", "doc_id", "text").collect()}
    assert got == {(x, i, t.index(x) + 1) for x in strings for i, t in texts if x in t}
    whole = df.select(df.doc_id.alias("tid"), "text")
    wanted = contained._few(contained._seeded(s.selectExpr("1L sid", "quote text"), "sid", 16, True))
    assert contained._seeded(whole, "tid", 16, False, wanted).count() < 0.1 * contained._seeded(whole, "tid", 16, False).count()


def test_a_line_of_many_documents_is_not_paired_out(spark, tmp_path):
    from ferrule.plans.retrieval import joi12_lines_elsewhere

    common, second = "a line that stands in every one of them", "another line that many of them have too"
    rows = [(i, "\n".join([common] + [second] * (i % 3 == 0) + [f"one of its own, number {i:05}"] * (i < 7))) for i in range(60)] + [(100, f"within: {second}!"), (101, "nothing at all here to be seen"), (102, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t in rows:
        of = {x: {j for j, u in rows if u and x in u and j != i} for x in (t or "").split("\n") if len(x) >= 20}
        others = set().union(*of.values())
        want += [(i, sum(map(bool, of.values())), len(others), min(others))] if others else []
    df = joi12_lines_elsewhere(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == want
    assert "doc_id#" not in "".join(x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "NOT (doc_id" in x)


def test_near_lines_of_a_document_shuffle_nothing(spark):
    import random

    from ferrule.operators import chunks

    rng = random.Random(9)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 5, 30]))] for _ in range(30)]
    lines = lambda: [" ".join(w if rng.random() > 0.03 else "new" for w in rng.choice(base)) if rng.random() > 0.1 else rng.choice(["", "  "]) for _ in range(40)]
    rows = [(i, "\n".join(lines())) for i in range(20)] + [(20, None), (21, "")]
    want = set()
    for i, t in rows:
        kept = []
        for c, line in enumerate(t.split("\n") if t is not None else []):
            s = set(line.split())
            alike = bool(s) and any(100 * len(s & k) >= 95 * len(s | k) for k in kept)
            kept += [] if alike or not s else [s]
            want.add((i, c, not alike))
    df = chunks.near_in_document(spark.createDataFrame(rows, "k long, t string"), "k", "t", 95)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in df.collect()} == want and len({x for *_, x in want}) == 2


def test_full_text_moves_blocks_once(spark, tmp_path):
    """Blocks, not single postings, meet by window, each once, however many queries ask for them; windows whose documents were read apart, in no order, lose nothing."""
    import random
    import re

    from ferrule.operators import fulltext

    rng = random.Random(16)
    words = ["Cats", "running", "hope", "\u212aelvin", "\u0130x", "d\u00e9j\u00e0", "\U0001d400", "the", "a.b", "x" * 70]
    docs = [(i, None if i % 50 == 7 else " ".join(rng.choices(words, k=i % 9))) for i in rng.sample(range(-9000, 9000), 500)] + [(None, "cats running"), (2**60, "Cats hope\u00a0running")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    index = fulltext.write_index(df, "doc_id", "text", f"file://{tmp_path}/index")
    queries = [(i, text) for i in range(3) for text in ["cats running", "hope", "kelvin cats", "absent cats"][i : i + 1]] + [(10 + i, "cats running hope") for i in range(20)]
    asked = fulltext.query_terms(spark.createDataFrame(queries, "q long, text string"), "q", "text").cache()
    blocks = fulltext.blocks_of(index, asked)
    split = {r.doc_id: set(r.w) for r in df.select("doc_id", fulltext.words_of("text").alias("w")).collect() if r.w}
    want = sorted((q, i) for q, text in queries for i, w in split.items() if i is not None and set(text.split()) <= w)
    got = [tuple(r) for r in fulltext.matches(blocks).collect()]
    assert sorted(x for x in got if x[1] is not None) == want and [q for q, i in got if i is None] == [0]
    for scored in (fulltext.rank, fulltext.density):
        assert sorted((r.q, r.doc) for r in scored(blocks).where("doc is not null").collect()) == want
        plan = scored(blocks)._jdf.queryExecution().executedPlan().toString()
        moved = re.findall(r"Exchange hashpartitioning\([^)]*(?:window|doc)#[^)]*", plan)
        assert len(moved) == 1 and "(window#" in moved[0] and "Generate" not in plan


def test_blocks_are_cut_by_bytes(monkeypatch):
    import pyarrow as pa

    from ferrule.operators import fulltext

    batch = pa.record_batch({"doc": pa.array(range(40)), "text": pa.array([None if i == 5 else "cat dog cat " * (i % 7) + "x" * (300 if i == 20 else 0) for i in range(40)])})
    for size in (1, 100, 1 << 20):
        monkeypatch.setattr(fulltext, "BYTES", size)
        rows = [r for b in fulltext._indexed(iter([batch.slice(0, 25), batch.slice(25)])) for r in b.to_pylist()]
        for term, step in (("cat", (0, 2)), ("dog", (1,))):
            of = [r for r in rows if r["term"] == term]
            assert len(of) > 1 or size > 100
            found = {d: n for r in of for d, n in zip(r["docs"], r["counts"])}
            assert found == {i: len(step) * (i % 7) for i in range(40) if i != 5 and i % 7} and max(r["most"] for r in of) == max(found.values())
            assert sorted(p for r in of for p in r["places"]) == sorted(3 * k + s + 1 for i in range(40) if i != 5 for k in range(i % 7) for s in step)


def test_a_buckets_windows_are_dealt_to_several_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from ferrule.operators import fulltext

    df = spark.range(0, 1_000_000, 10_000).select(F.col("id").alias("doc_id"), F.lit("cat").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        fulltext.write_index(df, "doc_id", "text", f"file://{tmp_path}/index")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "index").glob("bucket=*"))) == 1 and len(list((tmp_path / "index").glob("bucket=*/*.parquet"))) > 1


def test_stems_by_patterns_made_once(spark, monkeypatch):
    """A word is stemmed without looking up patterns by their text, to what the SQL steps make of it."""
    import random

    from ferrule.functions import stems

    rng = random.Random(21)
    ends = [*stems.PLURALS, *stems.DERIVED, *stems.SHORTENED, *stems.DROPPED, "ed", "ing", "eed", "ion", "y", "e", "ll", ""]
    words = sorted({"".join(rng.choices("abcehilnostuyz1", k=rng.randrange(7))) + rng.choice(ends) + rng.choice(ends) for _ in range(3000)})
    want = {r.term: r.stem for r in stems.stems(spark.createDataFrame([(w,) for w in words], "term string")).collect()}
    with monkeypatch.context() as m:
        m.setattr(stems, "re", None)
        got = {w: stems.stem.__wrapped__(w) for w in words}
    assert got == want


def test_lines_meet_by_digests_and_seeds_alone(spark, tmp_path, monkeypatch):
    """Which line holds which is told without writing the lines; lengths about those of the windows, pieces of long lines and lines with one beginning lose nothing."""
    import random

    from ferrule.operators import contained
    from ferrule.plans import retrieval

    rng = random.Random(30)
    made = lambda n, letters="abcdefgh \U0001d400": "".join(rng.choices(letters, k=n))
    long = [made(n) for n in (700, 900, 1500)]
    lines = [*long, *[made(n, "ab") for n in (20, 21, 25) for _ in range(9)]]
    for t in long:
        for n in (19, 20, 21, 39, 40, 41, 79, 80, 81, 200):
            c = rng.choice([0, len(t) - n, rng.randrange(len(t) - n)])
            lines += [t[c : c + n], t[c : c + n] + "!"]
    lines += [("x" * 30) + str(i) for i in range(5)] + ["x" * 30, "x" * 29, "x" * 90]
    want = {(s, t) for s in lines for t in lines if s != t and s in t and len(s) >= 20}
    df = spark.createDataFrame([(x,) for x in lines if len(x) >= 20], "line string").repartition(3)
    named = {bytes(r.id): r.line for r in df.select("line", contained.digest(df.line).alias("id")).collect()}
    for piece in (1 << 22, 50):
        monkeypatch.setattr(contained, "PIECE", piece)
        found = contained.lines_within(df, 20).collect()
        assert {(named[bytes(r.id)], named[bytes(r.within)]) for r in found} == want and len(found) == len(want) > 50

    docs = [(i, "\n".join([made(400), made(1000), *rng.sample(lines, 2)])) for i in range(60)] + [(60, None), (61, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    kept: list[str] = []
    for module in (contained, retrieval):
        monkeypatch.setattr(module, "shared_path", lambda _, name: kept.append(f"file://{tmp_path}/{name}") or kept[-1])
    got = {r.doc_id: (r.lines, r.others, r.first_other) for r in retrieval.joi12_lines_elsewhere(spark, str(tmp_path)).collect()}
    of = {i: {x: {j for j, u in docs if u and x in u and j != i} for x in (t or "").split("\n") if len(x) >= 20} for i, t in docs}
    assert got == {i: (sum(map(bool, x.values())), len(set().union(*x.values())), min(set().union(*x.values()))) for i, x in of.items() if any(x.values())}
    assert kept and not [c for path in kept for c, kind in spark.read.parquet(path).dtypes if "string" in kind]


def test_chunks_near_each_query_by_products(spark, tmp_path):
    """What LATERAL over every pair gives, odd vectors and missing languages included, from few pairs."""
    import random

    from ferrule.plans import extras

    rng = random.Random(44)
    kinds = ["en", "fr", "de", None]
    rows = [(i, [rng.gauss(0.3, 1) for _ in range(16)]) for i in range(1500)]
    rows = [(i, {300: None, 7: None, 8: [0.0] * 16, 400: [0.0] * 16, 9: [float("nan")] * 16, 10: [1.0] * 9, 11: rows[100][1], 12: rows[100][1]}.get(i, v)) for i, v in rows]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(i, kinds[0 if i in (7, 8, 9, 10, 11, 12, 100) else rng.randrange(4)], "x") for i in range(1600)], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "o_orderkey long, o_orderdate timestamp, o_orderstatus string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([], "l_orderkey long, l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(tuple(map(str, r)) for r in extras.sql02_similar_chunks(spark, str(tmp_path)).collect())
    every = spark.sql("SELECT q.chunk_id AS query_id, f.chunk_id, f.document_type, round(f.similarity_score, 6) AS score FROM (SELECT * FROM ferrule_chunks WHERE chunk_id % 100 = 0) q, LATERAL search_similar_chunks(q.embedding, 0.3D, q.document_type) f")
    assert got == sorted(tuple(map(str, r)) for r in every.collect()) and len(got) > 50
    assert spark.table("ferrule_likely").count() < 15 * 1500 / 2


def test_large_sets_that_share_words_do_not_meet(spark, monkeypatch):
    """Of large sets with many words in common, sketches as wide as they need leave the join few pairs; equal hashes of counters and sets of unlike sizes lose none."""
    import random

    from ferrule.operators import tables

    rng = random.Random(50)
    rows = [(i, sorted({f"w{rng.randrange(2600)}" for _ in range(rng.choice([1100, 1250, 1400]))})) for i in range(60)]
    rows += [(100 + i, sorted({f"v{rng.randrange(700)}" for _ in range(n)})) for i, n in enumerate([200, 250, 256, 300, 400, 600] * 8)]
    rows += [(1000 + i, sorted({*s[len(s) // 9 :], f"new{i}"})) for i, s in rows if i % 3 == 0] + [(3000 + i, s) for i, s in rows[:9]] + [(5000, []), (5001, None), (5002, ["w1"]), (5003, ["w1"])]
    sets = {k: set(s or ()) for k, s in rows}
    want = {(a, b): (len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows, "k long, s array<string>").repartition(5)
    told = tables.similar_pairs(df, "k", "s")
    assert {(r.x, r.y): (r.shared, r.every) for r in told.collect()} == want and len(want) > 40
    widths = [line.count("bit_count") for line in told._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line and "at_x" in line]
    assert len(widths) == len(tables.NARROW) and widths == sorted(set(widths))
    monkeypatch.setattr(tables, "COUNTED", 16)
    assert {(r.x, r.y): (r.shared, r.every) for r in tables.similar_rows(df, "k", "s").collect()} == want


def test_sets_are_told_apart_by_digests(spark):
    """Which sets are equal is told without shuffling a set."""
    from ferrule.operators import tables

    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["a", "b"]), (4, []), (5, None), (6, ["a"])], "k long, s array<string>").repartition(3)
    members, firsts = tables.set_classes(df, "k", "s")
    assert sorted(map(tuple, members.collect())) == [(1, 1, 2), (2, 2, 1), (3, 1, 2), (6, 2, 1)]
    assert sorted(r.k for r in firsts.collect()) == [1, 2]
    assert "Exchange hashpartitioning" not in firsts._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_checked_without_a_set_for_each(spark, monkeypatch):
    """In a group of sets that are all alike a set is sent to each part once at most, not to each of its pairs."""
    from ferrule.operators import tables

    monkeypatch.setattr(tables, "CHECKS", 3)
    common = [f"c{k:03}" for k in range(60)]
    df = spark.createDataFrame([(i, sorted([*common, f"own{i}"])) for i in range(40)], "k long, s array<string>")
    told = tables.similar_pairs(df, "k", "s")
    assert sorted(map(tuple, told.collect())) == [(x, y, 60, 62) for x in range(40) for y in range(x + 1, 40)]
    assert "array_intersect" not in told._jdf.queryExecution().optimizedPlan().toString() and "CoGroup" in told._jdf.queryExecution().optimizedPlan().toString()
