"""The stored index, stems and the containment join: against plain loops on small fixtures."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import pytest

from ferrule.functions.stems import STOP_WORDS, stem, stems
from ferrule.operators import contained, fulltext
from ferrule.sources.store import shared_path

WORDS = re.compile("[a-z0-9]+")
# Pairs of words and stems from the published description of the algorithm.
KNOWN = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc
digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr
electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler
probate probat rate rate cease ceas controll control roll roll yellow yellow""".split()


def test_stems_are_the_published_ones(spark):
    want = dict(zip(KNOWN[::2], KNOWN[1::2], strict=True)) | {"a": "a", "": "", "yy": "yy", "42": "42", "x11ed": stem("x11ed"), "yes": "ye"}
    got = {r.term: r.stem for r in stems(spark.createDataFrame([(w,) for w in want], "term string")).collect()}
    assert got == want == {w: stem(w) for w in want}


# -- the index


def places(text):
    out = defaultdict(list)
    for p, w in enumerate(WORDS.findall((text or "").lower()), 1):
        if w not in STOP_WORDS:
            out[stem(w)].append(p)
    return out


def pair(d):
    return 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))


def plain_rank(own):
    if len(own) == 1:
        return sum(0.1 / j**2 for j in range(1, len(own[0]) + 1)) / 1.64493406685
    out = 1.0
    for i, a in enumerate(own):
        for b in own[:i]:
            for x in a:
                for y in b:
                    out *= 1 - (pair(abs(x - y)) if abs(x - y) <= 100 else 0)
    return 1 - out


def plain_density(own):
    at = sorted((p, t) for t, ps in enumerate(own) for p in ps)
    out, before, last = 0.0, -1, {}
    for n, (p, t) in enumerate(at):
        last[t] = n
        if len(last) == len(own) and min(last.values()) > before:
            before = min(last.values())
            out += 0.1 / (1 + (p - at[before][0]) - (n - before))
    return out


@pytest.fixture(scope="module")
def indexed(spark):
    rng = random.Random(6)
    words = ["the", "running", "runs", "run", "cats", "cat", "motoring", "motor", "hopeful", "is", "x1", "été", "plaster"]
    docs = {rng.randrange(-20_000, 60_000): " ".join(rng.choices([*words, "filler"], weights=[*range(13, 0, -1), 900], k=rng.choice([0, 3, 90, 400]))) for _ in range(300)}
    docs |= {100_000: None, 100_001: "", 100_002: "plastered " + "the " * 150 + "x1", 100_003: "Cat." * 40}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    return docs, fulltext.write_index(df, "doc_id", "text", shared_path(spark, "index"))


QUERIES = [(1, "the running cat"), (2, "plaster"), (3, "Hopeful cats motored"), (4, "of the"), (5, None), (6, "absent cat"), (7, "x1 plastering hope run"), (8, "run running cat cats"), (9, "cats")]


@pytest.mark.parametrize("how", ["rank", "density"])
@pytest.mark.parametrize("first", [1, 1000])
def test_top_is_that_of_a_full_scan(spark, indexed, how, first, monkeypatch):
    monkeypatch.setattr(fulltext, "FIRST", first)
    docs, index = indexed
    asked = fulltext.query_terms(spark.createDataFrame(QUERIES, "item long, text string"), "item", "text").cache()
    got = defaultdict(list)
    for r in fulltext.top(index, asked, 7, how).collect():
        got[r.q].append((r.doc, round(r.score, 9)))
    plain = plain_rank if how == "rank" else plain_density
    for q, text in QUERIES:
        terms = list(places(text))
        found = [(i, [places(t)[s] for s in terms]) for i, t in docs.items()] if terms else []
        scored = sorted(((round(-plain(own), 12), i) for i, own in found if all(own)))[:7]
        assert sorted(got[q], key=lambda x: (-x[1], x[0])) == [(i, round(-s, 9)) for s, i in scored], q


def test_matches(spark, indexed):
    docs, index = indexed
    asked = fulltext.query_terms(spark.createDataFrame(QUERIES, "item long, text string"), "item", "text").cache()
    got = {(r.q, r.doc) for r in fulltext.matches(fulltext.blocks_of(index, asked)).collect()}
    assert got == {(q, i) for q, text in QUERIES for i, t in docs.items() if places(text) and set(places(text)) <= set(places(t))}


def test_a_search_reads_its_terms_alone(spark, indexed):
    index = indexed[1]
    asked = fulltext.query_terms(spark.createDataFrame([(1, "hopeful")], "item long, text string"), "item", "text").cache()
    plan = fulltext.blocks_of(index, asked)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#", plan) and re.search(r"PushedFilters: \[[^\n]*term,? ?\[?hope", plan)


def test_index_of_nothing(spark):
    index = fulltext.write_index(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", shared_path(spark, "index"))
    asked = fulltext.query_terms(spark.createDataFrame([(1, "cat")], "item long, text string"), "item", "text")
    assert fulltext.top(index, asked, 3).collect() == []


# -- containment


@pytest.mark.parametrize("least", [4, 10, 16])
def test_contained_by_brute_force(spark, least):
    rng = random.Random(least)
    texts = [(i, "".join(rng.choices("ab c日😀", k=rng.randrange(0, 300)))) for i in range(60)] + [(100, None), (101, ""), (102, "a" * 500), (103, "same line here") ] + [(200 + i, "x" * i + "same line here" + "y" * i) for i in range(20)]
    strings = [t[k : k + n] for _, t in texts[:40] if t for k, n in [(rng.randrange(0, 200), rng.randrange(1, 60))]] + ["same line here", "same line here", "a" * 40, "absent string that is long", "", None, "ab", "日"]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, place int")
    got = contained.contained(spark.createDataFrame([(s,) for s in strings], "quote string"), df, "quote", "doc_id", "text", least=least).collect()
    want = {(s, i, t.index(s) + 1) for s in set(strings) if s for i, t in texts if t and s in t}
    assert len(got) == len(want) and {(r.quote, r.doc_id, r.place) for r in got} == want
    assert contained.contained(spark.createDataFrame([], "quote string"), df, "quote", "doc_id", "text").collect() == []
