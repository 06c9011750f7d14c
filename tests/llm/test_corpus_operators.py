"""Lexical search, suffix-array duplicates and the divergence audit: against brute force on small fixtures."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ferrule.llm import divergence, lexical, repeats, staging

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# -- ranked lexical search


def ranked(docs, items, k):
    found = [(i, Counter(WORD.findall(lower(t)))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked, out = defaultdict(set), set()
    for item, t in items:
        asked[item] |= set(WORD.findall(lower(t)))
    for item, terms in asked.items():
        scored = []
        for i, c in found:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, i is None, i, s))
        out |= {(item, r, i, s) for r, (_, _, i, s) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)}
    return out


SEARCH = "doc_id long, text string, n long, window long, terms string, score long, rank int, at int, part int"


def test_search_by_brute_force(spark):
    rng = random.Random(3)
    words = ["the", "Été", "été", "a1", "x_y", "zz", "日本", "no.5", "😀", "İ", "q"]
    docs = [(rng.randrange(-9000, 60_000) if i % 7 else 5, " ".join(rng.choices(words, weights=range(11, 0, -1), k=rng.randrange(0, 60)))) for i in range(700)]
    docs += [(None, "the q the"), (8, None), (9, ""), (10, " ... "), (2**40, "q " * 30_000), (11, "the 日本 zz"), (12, "the 日本 zz"), (12, "the 日本 zz")]
    items = [(1, "The 日本, zz! the"), (2, None), (3, "absent"), (4, "q İ été x"), (4, "zz"), (None, "no 5"), (5, "")]
    want = ranked(docs, items, 20)
    df = spark.createDataFrame([(*d, 1, 2, "t", 3, 4, 5, 6) for d in docs], SEARCH)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in lexical.search(df, asked, k=20).collect()} == want
    got = lexical.search(df, asked, k=20, block_terms=3).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {tuple(r) for r in lexical.search(df, asked, k=20, window=8).collect()} == want  # windows with more rows than buckets


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], SEARCH), spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical.search(docs, items).collect() == []
    assert lexical.search(spark.createDataFrame([(1, None, 1, 2, "t", 3, 4, 5, 6)], SEARCH), items).collect() == []
    assert lexical.search(docs, items.where("item_id > 1")).columns == ["item_id", "rank", "doc_id", "score"]


def test_length_norm_beyond_64_bits():
    n = np.array([7, 10**9], np.int64)
    assert lexical.length_norm(n, 10**10, 10**12).tolist() == [20 * (50 + 50 * int(x) * 10**10 // 10**12) for x in n]


# -- long repeats


def cut(rows, length):
    """By brute force: each row's spans to be removed and the bytes that stay."""
    least = {}
    for i, t in rows:
        t = (t or "").encode()
        for k in range(len(t) - length + 1 if i is not None else 0):
            least[t[k : k + length]] = min(least.get(t[k : k + length], i), i)
    out = []
    for i, t in rows:
        t = (t or "").encode()
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1 if i is not None else 0):
            if least[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, len(t), tuple(spans), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def spans_of(df):
    return Counter((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in df.collect())


REPEATS = "doc_id long, text string, chunk long, ids string, marks int, found int, bucket int, n int, data string, spans string"


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdeéßxyz日", k=rng.randrange(2, 9))) for _ in range(n))


@pytest.mark.parametrize("hot", [2, 6, 4096])
def test_repeats_by_brute_force(spark, hot):
    rng = random.Random(hot)
    passages = [prose(rng, 20) for _ in range(4)]
    line = prose(rng, 8)
    rows = []
    for i in rng.sample(range(-500, 5000), 160):
        parts = [prose(rng, rng.randrange(0, 30)), rng.choice(passages)[rng.randrange(0, 40) :], prose(rng, 3), line if i % 3 else "", prose(rng, 5)]
        rng.shuffle(parts)
        rows.append((i, " ".join(parts)))
    rows += [(6001 + i, rows[i][1]) for i in range(12)] + [(rows[3][0], rows[3][1]), (rows[4][0], rows[4][1] + "x")]
    rows += [(None, passages[0]), (7001, None), (7002, ""), (7003, "a" * 49), (7004, "a" * 50), (7005, "a" * 300), (7006, "ab" * 200), (7007, "ba" * 30), (7008, "a" * 51), (7009, passages[1] * 3)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "i", 2, 3, 4, 5, "d", "s") for r in rows], REPEATS).repartition(5)
    assert spans_of(repeats.repeats(df, length=50, hot=hot)) == Counter(cut(rows, 50))


def test_repeats_of_long_texts(spark):
    """Texts of several slices and chunks, copies at any offset, and joins by shuffle."""
    rng = random.Random(9)
    letters = [rng.choice("abcdefgh ") for _ in range(1_300_000)]
    long, other = "".join(letters), "".join(reversed(letters))
    rows = [(1, long), (2, other[:300_000] + long[999_000:1_100_000] + other[300_000:]), (3, long[:70]), (4, long[1_048_500:1_048_600]), (5, other), (6, "z" * 100)]
    got = {r.doc_id: r for r in repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [[tuple(s) for s in got[i].spans] for i in (1, 3, 4, 6)] == [[], [(0, 70)], [(0, 100)], []]
    assert [(s.start, s.end) for s in got[2].spans] == [(300_000, 401_000)]
    assert [(s.start, s.end) for s in got[5].spans] == [(0, 1_300_000)]


def test_repeats_of_one_letter(spark):
    rows = [(i, "-" * n) for i, n in enumerate((49, 50, 51, 80, 400, 30_000))] + [(9, "=" * 70)]
    assert spans_of(repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == Counter(cut(rows, 50))


def test_repeats_of_nothing(spark):
    assert repeats.repeats(spark.createDataFrame([], REPEATS)).collect() == []


def test_run_index_streams_least_documents():
    rng = random.Random(4)
    parts = ["".join(rng.choices("ab", weights=[9, 1], k=rng.randrange(50, 90))).encode() for _ in range(300)] + [b"a" * 76, b"a" * 50, b"\xff" * 60]
    parts = list(dict.fromkeys(parts))
    least = np.array([rng.randrange(100) for _ in parts], np.int64)
    size = np.array([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    want = {}
    for p, d in zip(parts, least, strict=True):
        for k in range(len(p) - 49):
            want[p[k : k + 50]] = min(want.get(p[k : k + 50], d), d)
    index = repeats.RunIndex(data, np.concatenate(([0], np.cumsum(size))), least, 50)
    assert index.stream(size, 50).tolist() == [want[p[k : k + 50]] for p in parts for k in range(len(p) - 49)]
    for parts in ([b"a" * 50], [b"-" * 60, b"-" * 55], [b"ab" * 25], [b"a" * 49 + b"b", b"b" + b"a" * 49]):  # few letters and few bytes
        size = np.array([len(p) for p in parts])
        index = repeats.RunIndex(np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum(size))), np.arange(len(parts))[::-1], 50)
        want = {}
        for p, d in zip(parts, range(len(parts) - 1, -1, -1), strict=True):
            for k in range(len(p) - 49):
                want[p[k : k + 50]] = min(want.get(p[k : k + 50], d), d)
        assert index.stream(size, 50).tolist() == [want[p[k : k + 50]] for p in parts for k in range(len(p) - 49)]
    passage = prose(rng, 200).encode()
    parts = [passage[k : k + 70] for k in range(len(passage) - 70)]
    size = np.full(len(parts), 70)
    index = repeats.RunIndex(np.frombuffer(b"".join(parts), np.uint8), 70 * np.arange(len(parts) + 1), np.arange(len(parts)), 50)
    assert len(index.starts) < 8 * len(passage) < 70 * len(parts) / 8


# -- divergence audit

AUDIT = "doc_id long, text string, lang string, source string, n long, vec string, m long, first string, value long, size long"


def audited(rows, least, k):
    groups, docs, out = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        found = LETTERS.findall(lower(text))
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    kept = {g: {t for t, n in c.items() if n >= least} for g, c in docs.items()}
    share = {}
    for (lang, source), c in groups.items():
        size = sum(c[t] for t in kept[lang]) + 5 * len(kept[lang])
        share[lang, source] = {t: 1 + 10**9 * (c[t] + 5) // size for t in kept[lang]}
    for (lang, source), p in share.items():
        others = [(s, q) for (x, s), q in share.items() if x == lang and s != source]
        pairs = sorted((-sum(abs(p[t] - q[t]) for t in p), s.encode()) for s, q in others)
        out |= {(lang, source, "pair", s.decode(), -v, r) for r, (v, s) in enumerate(pairs, 1)}
        whole = sum((c for (x, _), c in groups.items() if x == lang), Counter())
        size = sum(whole[t] for t in p) + 5 * len(p)
        over = sorted((-(p[t] - q), t.encode()) for t in p if groups[lang, source][t] and p[t] > (q := 1 + 10**9 * (whole[t] + 5) // size))
        out |= {(lang, source, "term", t.decode(), -v, r) for r, (v, t) in enumerate(over[:k], 1)}
    return out


def test_audit_by_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "abcÉé日İ" for b in "xyzXß"] + ["a1b", "😀", "'q'"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(0, 30))), rng.choice(["en", "EN", None, "fr"]), rng.choice(["s1", "s2", None, "é", "😀"])) for _ in range(400)]
    rows += [(None, "en", "empty"), ("", "de", None), (None, None, None), ("word " * 30_000, "en", "s1"), ("only here", "xx", "s1"), *[("same text here", "fr", "s1")] * 9]
    df = spark.createDataFrame([(i, *r, 1, "v", 2, "f", 3, 4) for i, r in enumerate(rows)], AUDIT)
    want = audited(rows, 4, 6)
    got = divergence.audit(df, least=4, k=6).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    monkeypatch.setattr(divergence, "MAX_BROADCAST", 4)  # languages in blocks
    assert {tuple(r) for r in divergence.audit(df, least=4, k=6).collect()} == want


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], AUDIT)).collect() == []
    rare = spark.createDataFrame([(1, "a b", "en", s, 1, "v", 2, "f", 3, 4) for s in ("x", "y")], AUDIT)
    assert sorted(tuple(r) for r in divergence.audit(rare).collect()) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_strips_of_many_sources(monkeypatch):
    monkeypatch.setattr(divergence, "STRIP", 2)
    monkeypatch.setattr(divergence, "CELLS", 10)
    rng, names = random.Random(1), list("abcde")
    one = divergence._Language("en", names, [40 + i for i in range(5)])
    vecs = [([{"source": s, "n": rng.randrange(1, 9)} for s in names if rng.random() < 0.5], rng.randrange(1, 4)) for _ in range(7)]
    sums = np.zeros((5, 5), np.int64)
    for x in (x for v, m in vecs for x in one.add(v, m)):
        sums[x[0] : x[0] + len(x[1])] += x[1]
    for first, part in one.evaluate():
        sums[first : first + len(part)] += part
    p = [[1 + 10**9 * (next((x["n"] for x in v if x["source"] == s), 0) + 5) // (40 + i) for i, s in enumerate(names)] for v, _ in vecs]
    assert sums.tolist() == [[sum(m * abs(x[a] - x[b]) for x, (_, m) in zip(p, vecs, strict=True)) for b in range(5)] for a in range(5)]


def test_share_beyond_64_bits():
    n, size = np.array([0, 10**11, 7 * 10**12], np.int64), np.array([8 * 10**14, 10**12, 7 * 10**12 + 5], np.int64)
    assert divergence.share(n, size).tolist() == [1 + 10**9 * (int(a) + 5) // int(b) for a, b in zip(n, size, strict=True)]


def test_staged_tables_are_swept(spark, tmp_path):
    staging.sweep(spark)
    rows = spark.createDataFrame([(i, "the same long passage of some words that stands in every text of this table, " + str(i)) for i in range(9)], "doc_id long, text string")
    repeats.repeats(rows).write.parquet(str(tmp_path / "out"))
    kept = staging.stage(rows, "kept")
    staging.unstage(staging.stage(rows, "gone"))
    assert staging.sweep(spark) == 4  # chunks, answers, repeats and kept
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound"):
        kept.count()
    assert staging.sweep(spark) == 0 and spark.read.parquet(str(tmp_path / "out")).count() == 9
