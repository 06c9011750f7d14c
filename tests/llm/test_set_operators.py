"""Mixing, exact and near duplicates, url rules, embedding duplicates: against brute force on small fixtures."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.llm import embedding_dup, exact_dedup, graph, mixing, near_dup, url_filter
from ferrule.llm.queries import QUERIES, RULES
from tests.conftest import SF

DOCS = "doc_id long, text string, source string, n_shingles long, cls long, row_key long, keep_id long, kept boolean, _size long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, 7, 7, 7, False, 7) for i, t, s in rows], DOCS)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def roots(nodes, links):
    least = {n: n for n in nodes}

    def find(n):
        while least[n] != n:
            n = least[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# -- exact duplicates


def test_exact_by_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "A b", "a B", "ä", "Ä", "İ", "x" * 40_000, "X" * 40_000, "\u212a", "k"]
    rows = [(i, rng.choice(texts) if i % 3 else "the hot one", "s") for i in range(400)]
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[lower(t)].append(i)
    got = {r.doc_id: r for r in exact_dedup.decide(documents(spark, rows)).collect()}
    assert len(got) == 400
    for g in groups.values():
        for i in g:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(g), len(g), i == max(g))
    stay = exact_dedup.keep_first(documents(spark, rows))
    assert stay.columns == documents(spark, []).columns and sorted(r.doc_id for r in stay.collect()) == sorted(max(g) for g in groups.values())


def test_exact_with_repeated_rows_and_nulls(spark):
    df = documents(spark, [(1, "a", "s"), (1, "A", "s"), (1, "a", "s"), (None, "a", "s"), (None, None, None), (None, "", None)])
    assert Counter(r.kept for r in exact_dedup.decide(df).collect()) == {True: 2, False: 4}
    assert exact_dedup.keep_first(df).count() == 2
    assert exact_dedup.decide(documents(spark, [])).count() == 0 and exact_dedup.keep_first(documents(spark, [])).count() == 0


# -- near duplicates


def shingle_set(text, width):
    words = WORD.findall(lower(text))
    return {tuple(words)} if 0 < len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def near_brute(rows, width, percent=80):
    sets = {i: shingle_set(t, width) for i, t, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, roots(sets, links)


def corpus(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    shared = [rng.choice(vocabulary) for _ in range(60)]
    made = []
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 8, 40, 200]))] + shared * (g % 3 == 0)
        for c in range(rng.choice([1, 2, 5, 12])):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            made.append(" ".join(words).upper() if c % 4 == 3 else "  ".join(words))
    hot = [rng.choice(vocabulary) for _ in range(80)]
    for c in range(60):  # one group of near copies, each changed a little elsewhere
        words = list(hot)
        words[c % 80] = f"z{c}"
        made.append(" ".join(words))
    made += [None, "", " \t\n", "one", "One", "word " * 20_000]
    rng.shuffle(made)
    return [(i, t, "s") for i, t in enumerate(made)]


@pytest.mark.parametrize("width", [2, 5])
def test_near_by_brute_force(spark, width):
    rows = corpus()
    sets, want = near_brute(rows, width)
    got = {r.doc_id: r for r in near_dup.decide(documents(spark, rows), width=width).collect()}
    assert {i: got[i].n_shingles for i in got} == {i: len(s) for i, s in sets.items()}
    assert {i: got[i].component_id for i in got} == want
    assert all(got[i].kept == (want[i] == i) for i in got)


def test_near_when_all_buckets_are_split(spark, monkeypatch):
    """However small the blocks, no link between components is lost."""
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    rows = corpus(5)
    assert {r.doc_id: r.component_id for r in near_dup.decide(documents(spark, rows), width=2).collect()} == near_brute(rows, 2)[1]


@pytest.mark.parametrize("percent", [60, 75, 95, 100])
def test_near_at_other_thresholds(spark, percent):
    rows = corpus(6) + [(1000 + i, t, "s") for i, t in enumerate(["a b c d", "a b c d e", "a b c", "a b c d f", "b c d", "x y z", "x y z w"])]
    got = {r.doc_id: r.component_id for r in near_dup.decide(documents(spark, rows), width=1, percent=percent).collect()}
    want = near_brute(rows, 1, percent)[1]
    if percent >= 75:
        assert got == want
    else:  # bands are made for 0.8 and above: pairs at lower similarity may be missed, none is made up
        assert all(want[i] <= got[i] for i in got)


def test_near_keeps_one_and_its_columns(spark):
    rows = corpus(9)
    kept = near_dup.keep_one(documents(spark, rows))
    want = near_brute(rows, 5)[1]
    assert kept.columns == documents(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in want if want[i] == i)


def test_near_of_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(50))
    df = documents(spark, [(None, long, None), (3, long, None), (3, long, None), (2, None, None), (2, None, None)])
    got = sorted((r.doc_id or -1, r.component_id) for r in near_dup.decide(df).collect())
    assert got == [(-1, 3), (2, 2), (2, 2), (3, 3), (3, 3)]
    assert near_dup.decide(documents(spark, [])).count() == 0 and near_dup.keep_one(documents(spark, [])).count() == 0


def test_near_compares_all_of_a_large_bucket(spark, monkeypatch):
    """Families that share one passage, so that a pair has a single bucket, a large one, in common: no pair of blocks is left out."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = random.Random(21)
    made = []
    for g in range(30):
        base = [f"g{g}x{rng.randrange(10**6)}" for _ in range(120)]
        made += [" ".join(base[:k] + [f"new{g}y{k}"] + base[k + 1 :]) for k in (10, 60)]
    rows = [(i, t, "s") for i, t in enumerate(made)]
    docs = documents(spark, rows)
    same = F.concat(F.unhex(F.lit("01" * 2 * near_dup.ROWS)), F.expr(f"substring(registers, {2 * near_dup.ROWS + 1})"))  # all agree in the first band
    classes = near_dup.stage(near_dup.sketch_documents(docs, 2, 80).select("doc_id", "row_key", F.col("doc_id").alias("cls"), F.col("n_shingles").alias("n"), same.alias("registers")), "classes")
    texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    found = near_dup.find_roots(classes, texts, near_dup.bands_of(classes), 2, 80)
    cls = {r.cls: r.doc_id for r in classes.collect()}
    got = defaultdict(set)
    for r in found.collect():
        got[r.root].add(cls[r.node])
    assert sorted(map(sorted, got.values())) == [[2 * g, 2 * g + 1] for g in range(30)]


def test_near_keeps_one_of_every_component_with_null_or_repeated_ids(spark):
    long = lambda x: " ".join(f"{x}{i}" for i in range(50))
    rows = [(None, long("a"), "s"), (None, long("b"), "s"), (None, long("b").upper(), "s"), (4, long("c"), "s"), (4, long("d"), "s"), (4, long("d"), "s"), (7, long("d"), "s"), (None, long("e"), "s"), (9, long("e"), "s")]
    kept = Counter((r.doc_id, lower(r.text)[:1]) for r in near_dup.keep_one(documents(spark, rows)).collect())
    assert kept == Counter([(None, "a"), (None, "b"), (4, "c"), (4, "d"), (9, "e")])


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for share in (0.5, 0.8, 0.95):
        n = int(3000 * 2 * share / (1 + share))
        b = np.concatenate((a[:n], rng.integers(0, 2**63, 3000 - n, dtype=np.uint64)))
        s = near_dup.sketches(np.concatenate((np.sort(a), np.sort(b))), np.array([0, 3000, 6000]))
        assert near_dup.estimate(s[:1], s[1:])[0] == pytest.approx(share, abs=0.1)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (300, 200), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 300: 100}
    assert graph.components(spark.createDataFrame([(7, 7)], "a long, b long")) is None
    assert {*zip(*(x.tolist() for x in graph.forest(np.array([5, 9, 2, 8]), np.array([3, 5, 8, 8]))), strict=True)} == {(5, 3), (9, 3), (8, 2)}


# -- mixing


@pytest.mark.parametrize("blocks", [1, 2, 7, 1023, 1024, 4096])
def test_position_is_a_seeded_permutation(spark, blocks):
    n = F.lit(blocks).cast("long")
    rows = spark.range(blocks).select("id", mixing.position(F.col("id"), n, 1).alias("a"), mixing.position(F.col("id"), n, 2).alias("b")).collect()
    assert sorted(r.a for r in rows) == sorted(r.b for r in rows) == list(range(blocks))
    if blocks < 1000:
        return
    for c in ("a", "b"):  # the first draws lie all over the source: each sixteenth of its blocks has its share
        drawn = [r.id for r in rows if r[c] < blocks // 4]
        share = Counter(16 * i // blocks for i in drawn)
        assert len(share) == 16 and max(share.values()) < 2 * blocks // 64 and min(share.values()) > blocks // 128
        assert sum(i + 1 in set(drawn) for i in drawn) < len(drawn) / 2
    assert sum(r.a == r.b for r in rows) < 20



def targets_brute(sizes, weights, most=3):
    total, left = sum(sizes.values()), dict(sizes)
    out = {}
    words = total
    while left:
        share = {s: words * weights[s] / sum(weights[x] for x in left) for s in left}
        over = [s for s in left if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            words -= out[s]
            del left[s]
    return out


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 400)), rng.choices([None, "a", "b", "c", "tiny", "é"], [3, 30, 10, 40, 0.5, 8])[0]) for i in range(900)]
    rows += [(2000, None, "a"), (2001, "v " * 9000, "b"), (2001, "v " * 9000, "b"), (2002, "", "only empty")]
    return rows, spark.createDataFrame([(i, t, s, 7) for i, t, s in rows], "doc_id long, text string, source string, _kept long")


def test_mix_meets_its_targets(spark, mixed, tmp_path):
    rows, df = mixed
    df.drop("_kept").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op3_mixing"](spark, str(tmp_path)).collect()
    source = {(i, len(WORD.findall(t or ""))): s for i, t, s in rows}
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    want = targets_brute(sizes, {s: 1 + i % 3 for i, s in enumerate(order)})
    taken = Counter()
    for r in got:
        s = source[(r.doc_id, r.size)]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-9, abs=1e-6)
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = QUERIES["op3_mixing"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert all((r.taken > 0) <= (len(r.shards) > 0) for r in got) and {x for r in got for x in r.shards} == set(range(16))


def test_mix_keeps_repeated_rows_apart(spark, tmp_path):
    spark.createDataFrame([(1, "a b c", "s"), (2, None, "s"), (2, None, "s"), (3, "d e", "s"), (3, "d e", "s")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.size, r.taken) for r in QUERIES["op3_mixing"](spark, str(tmp_path)).collect())
    assert got == [(1, 3, 3), (2, 0, 0), (2, 0, 0), (3, 2, 2), (3, 2, 2)]


def test_mix_takes_what_the_tree_deals_out(spark, mixed, monkeypatch):
    """With half of the leaves taken away, their draws are missing from what is taken."""
    measured = mixing.stage(mixing.measure(mixed[1]), "measured")
    every = mixing.draws(measured).groupBy("_shard").agg(F.sum("_words").alias("n"), F.count("_draw").alias("draws"))
    by_shard = {r["_shard"]: r.n for r in every.where("_shard is not null").collect()}
    assert len(by_shard) == 16 and max(by_shard.values()) < 1.2 * min(by_shard.values())
    tree = mixing.split_tree
    monkeypatch.setattr(mixing, "split_tree", lambda *a: tree(*a).where("shard < 8"))
    assert mixing.draws(measured).agg(F.sum("_words")).first()[0] == sum(n for k, n in by_shard.items() if k < 8)


def test_mix_of_whole_documents(spark, mixed):
    rows, df = mixed
    made = mixing.mix(df)
    assert made.columns == df.columns
    words = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    copies = Counter(r.doc_id for r in made.collect())
    assert all(n <= 3 * (1 + (i == 2001)) and words[i] for i, n in copies.items())
    assert mixing.mix(df.limit(0)).count() == 0
    assert [r.doc_id for r in made.collect()] == [r.doc_id for r in mixing.mix(df).collect()]


def test_tree_splits_exactly_and_fairly(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 37), ("c", 0), ("d", 5)], "source string, draws long")
    rows = mixing.split_tree(quotas, 3, seed=11).collect()
    total = Counter()
    for r in rows:
        total[r.source] += r.n
        assert r.n >= 0
    assert {s: total[s] for s in "abcd"} == {"a": 1000, "b": 37, "c": 0, "d": 5}
    shards = Counter()
    for r in rows:
        shards[r.shard] += r.n
    assert len(shards) == 8 and max(shards.values()) - min(shards.values()) <= 3


def test_hypergeometric_follows_its_law(spark):
    n = 4000
    df = spark.range(n).select(mixing.hypergeometric(F.lit(50).cast("long"), F.lit(20).cast("long"), F.lit(10).cast("long"), mixing.uniform(F.col("id"))).alias("k"))
    k = [r.k for r in df.collect()]
    assert 0 <= min(k) and max(k) <= 10
    assert np.mean(k) == pytest.approx(4.0, abs=0.1) and np.var(k) == pytest.approx(10 * 0.4 * 0.6 * 40 / 49, rel=0.1)


# -- url rules


def test_urls_by_brute_force(spark):
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "notexample.com", "a.b.net", "net", "com", "x.org", "", "a:80", "fr.net"]
    urls = [f"{p}{h}{path}" for p in ("http://", "https://", "://", "") for h in hosts for path in ("", "/", "/en/", "/en", "/en/x?y=/fr/", "/fr/#a", "/es/?q", "?/en/", "#/en/", "/EN/")] + [None, "", "no scheme", "x://y://z/en/", "a\nb://example.com/en/"]
    rows = [(i, u, "h") for i, u in enumerate([*urls, *urls[:20]])]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host string"), RULES).collect()}
    assert len(got) == len(rows)
    for i, u, _ in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = lower(re.split(r"[/?#]", rest)[0])
        path = re.split(r"[?#]", rest[len(host) :])[0]
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), u


def test_urls_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(empty, RULES).count() == 0
    assert [r.verdict for r in url_filter.judge(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"), []).collect()] == ["allow"]


# -- embeddings


def test_vectors_by_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((30, 16))
    rows = []
    for i in range(500):
        c = centres[0] if i % 3 == 0 else centres[i % 30]
        v = (c + rng.standard_normal(16) * rng.choice([0.05, 0.3, 0.6])) * rng.choice([1.0, 100.0])
        rows.append((i, [float(x) for x in v], i % 7))
    rows += [(600 + i, rows[0][1], 1) for i in range(20)]
    rows += [(700, None, 1), (701, [], 1), (702, [0.0] * 16, 1), (703, [None] + [1.0] * 15, 1), (704, [float("nan")] + [1.0] * 15, 1), (705, [float("inf")] + [1.0] * 15, 1)]
    df = spark.createDataFrame([(i, v, n, 5, 5) for i, v, n in rows], "vec_id long, embedding array<double>, label long, cls long, root long")
    got = {r.vec_id: r for r in embedding_dup.find_links(df).collect()}
    good = [(i, np.array(v)) for i, v, _ in rows if i < 700]
    ids, m = [i for i, _ in good], np.array([v / np.linalg.norm(v) for _, v in good])
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    links = {i: int(n) for i, n in zip(ids, near.sum(1), strict=True)}
    found = sum(got[i].n_links for i in ids)
    assert all(got[i].n_links <= links[i] for i in ids) and found >= 0.95 * sum(links.values())
    want = roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    assert np.mean([got[i].component_id == want[i] for i in ids]) >= 0.95
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(700, 706))
    assert embedding_dup.find_links(df.limit(0)).count() == 0


def test_vectors_of_several_lengths_and_at_the_threshold(spark):
    edge = [0.9, math.sqrt(1 - 0.81)]
    under = [0.8999999999995, math.sqrt(1 - 0.8999999999995**2)]
    rows = [(1, [1.0, 0.0]), (2, under), (3, [-1.0, 0.0]), (4, [-2.0, 0.0]), (5, [0.0, 1e300]), (6, [0.0, 1e-300]), (7, [1.0, 1.0, 0.0]), (8, [1.0, 1.0, 0.0]), (9, [2.0, 2.0, 0.1]), (10, [1.0] * 5), (11, None), (12, [])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dup.find_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 5), 7: (2, 7), 8: (2, 7), 9: (2, 7), 10: (0, 10), 11: (0, 11), 12: (0, 12)}
    assert embedding_dup.at_least(np.array([[1.0, 0.0], [1.0, 0.0]]), np.array([edge, under]), 0.9).tolist() == [True, False]


@pytest.mark.parametrize("block, dense", [(4, 1), (4, 64), (4096, 1)])
def test_vectors_whatever_the_blocks(spark, monkeypatch, block, dense):
    monkeypatch.setattr(embedding_dup, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((4, 8))
    m = np.concatenate([base[i % 4] + rng.standard_normal(8) * 0.25 for i in range(120)]).reshape(-1, 8)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    pairs = set()
    g = np.zeros(120, np.int64)
    monkeypatch.setattr(embedding_dup, "DENSE", dense)
    for p, q in embedding_dup.close(g, np.arange(120) % 2, np.full(120, True), u, 0.9):
        pairs |= set(zip(p.tolist(), q.tolist(), strict=True))
    assert {(min(x), max(x)) for x in pairs} == {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j}
    got = embedding_dup.find_links(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")).collect()
    assert sum(r.n_links for r in got) >= 0.95 * near.sum() and all(r.n_links <= near[r.vec_id].sum() for r in got)


def test_vectors_recall_over_the_whole_table(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding]
    m = np.array([r.embedding for r in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = int((m @ m.T >= 0.9).sum()) - len(m)
    assert QUERIES["op10_embeddings"](spark, SF).agg(F.sum("n_links")).first()[0] >= 0.9 * want


@pytest.mark.parametrize("share", [1 / 3, 0.6])
def test_vectors_recall_in_a_dominant_group(share):
    """Pairs at 0.90 to 0.92 in a group that holds much of the table, with a direction that all vectors share, keyed as for 200,000 rows."""
    rng = np.random.default_rng(12)
    noise = lambda n: rng.standard_normal((n, 64)) / 8
    common, centre = noise(1), noise(1)

    def made(n):
        inside = int(n * share)
        group = embedding_dup.unit(common + centre)
        return np.vstack([embedding_dup.unit(group + 0.315 * noise(inside)), embedding_dup.unit(common + noise(n - inside))])

    mean, planes, bits, count = embedding_dup.learn(made(3000), 200_000, 0.9)
    fresh = made(1500)
    s = np.triu(fresh @ fresh.T, 1)
    p, q = np.nonzero((s >= 0.9) & (s < 0.92))
    assert len(p) > 10_000
    p, q = p[:10_000], q[:10_000]
    codes = ((fresh - mean) @ planes > 0).reshape(len(fresh), count, bits)
    assert (codes[p] == codes[q]).all(2).any(1).mean() >= 0.96


def test_one_vector_and_a_dominant_group(spark):
    one = embedding_dup.find_links(spark.createDataFrame([(3, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [tuple(r) for r in one] == [(3, 0, 3, True)]
    rng = np.random.default_rng(13)
    centre = rng.standard_normal(64)
    v = np.vstack([centre + 0.32 * rng.standard_normal((600, 64)), rng.standard_normal((400, 64))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = int((v @ v.T >= 0.9).sum()) - len(v)
    assert 0.96 * want <= embedding_dup.find_links(df).agg(F.sum("n_links")).first()[0] <= want
