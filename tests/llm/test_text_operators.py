"""Packing, toxicity, language, language-model scores, chat formatting: exact round trips, brute force and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferrule.llm import chat_format, kernels, language_id, lm_score, packing, toxicity
from ferrule.llm.queries import QUERIES, tokenizer_file
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part long, before long, ids string, row long, score double"
ODD = [None, "", " ", "\n\n\n", "a", "a  b\t\tc \n d", "Ünïcode ß 漢字  x y 🙂🙂", "<|endoftext|> [INST]", "don't  stop--now... 12345 1,000.5", "word " * 30_000, "x" * 50_000]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, 1, 2, "c", 3, 0.5) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def vocabulary():
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    return tokenizers.Tokenizer.from_file(tokenizer_file())


def test_pieces_that_share_a_hash_get_their_own_ids(vocabulary):
    column = pa.array(["One line, and more. ", None, "another"])
    known = packing.PieceEncoder(tokenizer_file(), added=True)
    first = known.encode(column, 1)
    known.raw[:3] = b"xyz"  # as if what is known under these hashes were another text's
    assert [x.tolist() for x in known.encode(column, 1)] == [x.tolist() for x in first]
    assert first[1].tolist() == [1] and known.tokenizer.decode(first[0].tolist()[:-1]) == "One line, and more. "


def test_packing_round_trip(spark, vocabulary):
    sentences = [f"Plain sentence number {i}, with signs; and a line\nend. " * (i % 9) for i in range(60)]
    texts = [*ODD, *sentences, *sentences[:5]]
    rows = packing.pack(documents(spark, texts).repartition(5), tokenizer_file(), length=128).collect()
    vocabulary.encode_special_tokens = True
    want = {i: [*vocabulary.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    pieces: dict[int, list] = {}
    places = []
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length > 0 and r.doc_tokens == len(want[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, ids))
        places.append((r.sequence_id, r.offset, r.length))
    assert {k: [x for _, ids in sorted(v) for x in ids] for k, v in pieces.items()} == want
    places.sort()
    at = 0
    for sequence, offset, length in places:  # no gap, and all windows but the last full
        assert sequence * 128 + offset == at and offset + length <= 128
        at += length


def test_packing_query_gives_the_untouched_tokenizers_ids(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    untouched = tokenizers.Tokenizer.from_file(tokenizer_file())
    e = "<|endoftext|>"
    texts = [*ODD, f"a {e} b", f"a  {e}  b", e, e + e, f"x\n\n{e}\n\ny", f"it{e}'s é{e}é\n{e}\nz", "<|endof", "text|> tail", e[:-1]]
    documents(spark, texts).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    want = {i: [*untouched.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert want[len(ODD)] == [64, 220, 50256, 275, 1]
    got = {i: [] for i in want}
    for r in packing.pack(spark.read.parquet(str(tmp_path / "documents.parquet")), tokenizer_file(), added=True).orderBy("doc_id", "start").collect():
        got[r.doc_id] += np.frombuffer(bytes(r.ids), "<u4").tolist()
    assert got == want
    assert {r.doc_id: r.doc_tokens for r in QUERIES["op1_packing"](spark, str(tmp_path)).collect()} == {i: len(x) for i, x in want.items()}


def test_packing_of_nothing(spark, vocabulary):
    assert packing.pack(documents(spark, []), tokenizer_file()).count() == 0


@pytest.fixture(scope="module")
def tables(spark):
    return lambda t: spark.read.parquet(f"{SF}/{t}.parquet")


def test_language_on_held_out_rows(spark, tables):
    rows = QUERIES["op4_language_id"](spark, SF).join(tables("documents").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == tables("documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.lang and any(c.isalpha() for c in r.text or "")]
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark):
    train = [("the cat sat on the mat and the dog", "en"), ("der hund und die katze sind nicht hier", "de")] * 20
    fit = language_id.fit(spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(train)], "doc_id long, text string, lang string"))
    docs = documents(spark, ODD)
    got = {r.doc_id: r for r in language_id.predict(docs, fit).collect()}
    for i, t in enumerate(ODD):
        lettered = any(c.isalpha() for c in t or "")
        assert (got[i].lang_pred == "und") == (not lettered)
        assert lettered or got[i].score == 0
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}
    kept = language_id.keep_known(docs, fit)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].lang_pred != "und"}
    assert language_id.fit(docs) is None
    assert language_id.predict(documents(spark, []), fit).count() == 0


def test_language_of_signs_beyond_the_first_plane(spark):
    fit = language_id.fit(spark.createDataFrame([(1, "the cat sat", "en"), (2, "der hund und", "de")] * 5, "doc_id long, text string, lang string"))
    docs = documents(spark, ["🙂🙂 🎉", "𝄞", "𠀀𠀁", "🙂 cat"])
    got = {r.doc_id: (r.lang_pred == "und", r.score == 0) for r in language_id.predict(docs, fit).collect()}
    assert got == {0: (True, True), 1: (True, True), 2: (False, False), 3: (False, False)}
    assert sorted(r.doc_id for r in language_id.keep_known(docs, fit).collect()) == [2, 3]


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables("documents"), tables("labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.fit(docs, labels.where(~fold))
    rows = toxicity.score(docs, model).withColumnRenamed("toxic", "found").join(labels.where(fold), "doc_id").collect()
    yes, no = [r.severity for r in rows if r.toxic], [r.severity for r in rows if r.toxic == 0]
    assert np.mean([a > b for a in yes for b in no]) > 0.9  # area under the curve
    assert list(model.thresholds) == sorted(model.thresholds) and all(0 <= r.severity <= 2 for r in rows)


def test_toxicity_of_odd_texts(spark):
    docs = documents(spark, [*ODD, *["vile slur words"] * 10, *["calm kind words"] * 30])
    labels = spark.createDataFrame([(i, int(i < len(ODD) + 10)) for i in range(len(ODD), len(ODD) + 40)] + [(0, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(rows) == docs.count()
    assert all(rows[i].toxic for i in range(len(ODD), len(ODD) + 10)) and not any(rows[i].toxic for i in range(len(ODD) + 10, len(rows)))
    none = toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 0"))).collect()
    assert max(r.severity for r in none) < 1e-6
    assert toxicity.score(documents(spark, []), toxicity.fit(docs, labels)).count() == 0


def backoff(texts, order=2, alpha=0.4):
    """Tokens and the summed logarithm of each text, by the counts of all other texts."""
    docs = [re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    grams = lambda d: Counter(tuple(d[i : i + n]) for n in range(1, order + 1) for i in range(len(d) - n + 1))
    own = [grams(d) for d in docs]
    total = Counter()
    for g in own:
        total.update(g)
    words = sum(map(len, docs))

    def value(run, mine, rest):
        c = total[run] - mine[run]
        if len(run) == 1:
            return math.log(max(c, 1) / max(rest, 1))
        return math.log(c / (total[run[:-1]] - mine[run[:-1]])) if c else math.log(alpha) + value(run[1:], mine, rest)

    return [(len(d), math.fsum(value(tuple(d[max(0, i - order + 1) : i + 1]), g, words - len(d)) for i in range(len(d))) if d else None) for d, g in zip(docs, own, strict=True)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_by_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 3000)
    rng = random.Random(3)
    texts = [*[t for t in ODD if not t or len(t) < 1000], *[" ".join(rng.choice("the Of and tree sky sea run".split()) for _ in range(rng.randrange(1, 60))) for _ in range(80)], "the " * 5000, "only here", "Only HERE"]
    got = {r.doc_id: r for r in lm_score.score(documents(spark, texts).repartition(3), order).collect()}
    assert len(got) == len(texts)
    for i, (n, s) in enumerate(backoff(texts, order)):
        assert got[i].n_tokens == n
        assert (s is None and got[i].log_score is None) or got[i].log_score == pytest.approx(s, rel=1e-9)
    assert lm_score.score(documents(spark, [])).count() == 0
    assert [r.log_score for r in lm_score.score(documents(spark, ["alone"])).collect()] == [0.0]


def test_scores_over_the_whole_table(spark, tables):
    texts = [r.text for r in tables("documents").orderBy("doc_id").collect()]
    rows = [r for r in QUERIES["op5_lm_score"](spark, SF).orderBy("doc_id").collect()]
    for (n, s), r in zip(backoff(texts), rows, strict=True):
        assert r.n_tokens == n and (s is None or r.log_score == pytest.approx(s, rel=1e-9))


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>user<|says|>x<|end|>\n", "<\\|", "<\\\\|turn", "\\", "[\\INST]", "<<SYS>> <</SYS>> <<\\SYS>>", "", None, "tab\tand\nnewline", "🙂 $1 \\\\ $", "w " * 50_000]
    rows = [(c, t, role, text, "x") for c in range(len(nasty)) for t, (role, text) in enumerate([("user", nasty[c]), ("assistant", nasty[(c + 1) % len(nasty)]), ("<|odd", nasty[(c + 2) % len(nasty)])])]
    rows += [(100, 0, None, None, "x"), (100, 0, None, None, "x"), (None, None, "user", "a", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = chat_format.format_chats(df)
    back = {r.conv_id: [(x.role, x.text) for x in r.read] for r in chat_format.read_back(made).collect()}
    for c in range(len(nasty)):
        assert back[c] == [(r[2], r[3] or "") for r in rows if r[0] == c]
    assert back[100] == [("", "")] * 2 and back[None] == [("user", "a")]
    for r in made.collect():
        assert r.formatted == "".join(s.text for s in r.segments)
        assert r.conv_id is None or r.conv_id >= 100 or not r.valid
    d = {r.conv_id: r for r in chat_format.digests(made).collect()}
    assert d[0].loss_sha256 == hashlib.sha256((nasty[1] or "").encode()).hexdigest()
    assert chat_format.digests(chat_format.format_chats(df.limit(0))).count() == 0


def test_turn_order(spark):
    talks = {1: ["system", "user", "assistant"], 2: ["user", "assistant", "user"], 3: ["assistant"], 4: ["user", "user"], 5: ["system"], 6: ["user", "assistant", "assistant"]}
    df = spark.createDataFrame([(c, i, role, "t") for c, roles in talks.items() for i, role in enumerate(roles)], "conv_id long, turn long, role string, text string")
    assert {r.conv_id for r in chat_format.format_chats(df).where("valid").collect()} == {1, 2}


# -- hashes


def test_hashes_have_no_fixed_collisions(spark):
    """Words in the Thue-Morse order of two letters and their mirror images collide in every polynomial modulo a power of two."""
    from ferrule.llm import near_dup
    from ferrule.llm.kernels import span_hashes

    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    words = [(word[:n].translate(str.maketrans("ab", "xy")), word[:n].translate(str.maketrans("ab", "yx"))) for n in (1024, 2048, 4096)]
    for pair in words:
        a, b = (np.frombuffer(w.encode(), np.uint8) for w in pair)
        assert span_hashes(a, np.array([0]), np.array([len(a)])) != span_hashes(b, np.array([0]), np.array([len(b)]))
    rows = [(2 * k + i, w) for k, pair in enumerate(words) for i, w in enumerate(pair)]
    got = near_dup.decide(spark.createDataFrame(rows, "doc_id long, text string"), width=2, percent=80).collect()
    assert all(r.component_id == r.doc_id and r.kept for r in got) and len(got) == 6


def test_hash_is_that_of_the_bytes_alone():
    from ferrule.llm.kernels import span_hashes

    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, 5000).astype(np.uint8)
    starts = rng.integers(0, 4000, 400)
    ends = starts + rng.integers(0, 100, 400)
    short = ends - starts < 60
    whole, alone = span_hashes(data, starts, ends), span_hashes(data, starts[short], ends[short])
    assert (whole[short] == alone).all()
    seen = {}
    for s, e, h in zip(starts, ends, whole, strict=True):
        assert seen.setdefault(data[s:e].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


# -- the models against plain arithmetic


def plain_bits(text):
    """The kernel's features of one text, character by character."""
    units = [ord(c) if c.isalpha() else 32 for c in text.lower()]
    out = set()
    for i in range(len(units)):
        h = 0
        for n, factor in enumerate((2654435761, 2246822519, 3266489917)):
            if i + n < len(units):
                h = (h + units[i + n]) * factor % 2**32
                h ^= h >> 15
                out.add((h * 2246822507 % 2**32) >> 20)
    return out


def test_presence_by_plain_loops():
    texts = ["", "a", "Ab c", "ÄÖ 12 日本", "the cat" * 50, "x😀y"]
    bits, lettered = language_id.presence(texts)
    assert [set(np.flatnonzero(row)) for row in bits] == [plain_bits(t) for t in texts]
    assert lettered.tolist() == [any(c.isalpha() for c in t) for t in texts]


def test_ridge_by_direct_solution():
    """Scores are those of the weighted least squares on kernels of sets, solved for the landmarks' coefficients without a basis."""
    rng = np.random.default_rng(3)
    vocabulary = {"en": "the cat sat on mats with dogs and birds", "de": "der hund und die katze sind nicht hier", "fr": "le chat et les chiens sont dans la maison"}
    rows = [(" ".join(rng.permutation(v.split())[: rng.integers(2, 6)]) + " " + "".join(rng.choice(list("abcxyz"), 5)), k) for k, v in vocabulary.items() for _ in range(14)]
    texts, langs = [t for t, _ in rows], [k for _, k in rows]
    model = language_id.fit_bits(language_id.presence(texts)[0], langs, landmarks=4, ridge=1e-2)
    names = sorted(vocabulary)
    sets = [plain_bits(t) for t in texts]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    marks = [[s for s, k in zip(sets, langs, strict=True) if k == name][:4] for name in names]
    marks = [s for each in marks for s in each]
    k_nm, k_mm = np.array([[kernel(a, b) for b in marks] for a in sets]), np.array([[kernel(a, b) for b in marks] for a in marks])
    weight = np.array([len(rows) / langs.count(k) / len(names) for k in langs])
    y = np.array([[1.0 if k == name else -1.0 for name in names] for k in langs])
    x = np.hstack([k_nm, np.ones((len(rows), 1))])
    penalty = np.zeros((len(marks) + 1,) * 2)
    penalty[:-1, :-1] = 1e-2 * len(rows) * k_mm
    solved = np.linalg.solve(x.T @ (weight[:, None] * x) + penalty, x.T @ (weight[:, None] * y))
    new = ["the dogs sat", "katze und hund", "la maison est", "zzz"]
    got = model.scores(language_id.presence(new)[0])
    raw = np.array([[kernel(plain_bits(t), m) for m in marks] + [1.0] for t in new]) @ solved
    want = np.exp(6 * raw) / np.exp(6 * raw).sum(1, keepdims=True)
    assert np.abs(got - want).max() < 1e-4


def test_language_of_repeated_rows_and_ties(spark):
    fit = language_id.fit(spark.createDataFrame([(1, "aaa", "x"), (2, "aaa", "b")] * 4, "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, "aaa", "t")] * 3 + [(1, "bbb", "t")], "doc_id long, text string, lang_pred string")
    got = language_id.predict(docs, fit).collect()
    assert [r.lang_pred for r in got] == ["b"] * 4 and len({r.score for r in got[:3]}) == 1  # of equal scores the first language


def plain_features(text):
    found = set()
    for word in re.findall("[0-9a-z\\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)):
        raw = np.frombuffer(word.encode(), np.uint8)
        h = lambda k: int(kernels.span_hashes(raw, np.array([0]), np.array([k]))[0])
        found.add(h(len(raw)) >> 42)
        found |= {(h(k) * (2 * k + 1) % 2**64) >> 42 for k in (4, 5, 6) if len(raw) > k}
    return found


def test_toxic_features_by_plain_loops():
    texts = ["", "Calm, kind words!", "x" * 90 + " éé12 longerword", None]
    found, bounds, sizes = toxicity.features(pa.array(texts))
    assert [set(found[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [plain_features(t or "") for t in texts]
    assert sizes.tolist() == [0, 3, 3, 0]


def test_ordinal_fit_by_dense_likelihood():
    """At the fit the dense likelihood, differentiated numerically, meets the conditions of the constrained optimum (without the pull on thresholds)."""
    rng = np.random.default_rng(5)
    n, m, l1 = 160, 6, 1e-2
    x = rng.random((n, m)) < 0.4
    grade = np.digitize(x @ np.array([2.0, 1.5, 0.8, 0, 0, 0]) + rng.logistic(size=n), [1.5, 3.0])
    rows, cols = np.nonzero(x)
    w, theta = toxicity._cumulative_fit(rows, cols, n, m, grade, 2, l1, rounds=4000, pull=0.0)
    weight = np.where(grade > 0, np.sqrt((grade == 0).sum() / (grade > 0).sum()), 1.0)

    def loss(w, theta):
        above = np.hstack([np.ones((n, 1)), 1 / (1 + np.exp(theta - (x @ w)[:, None])), np.zeros((n, 1))])
        own = above[np.arange(n), grade] - above[np.arange(n), grade + 1]
        return -(weight * np.log(own)).sum() / n

    step = lambda f, v: np.array([(f(v + e) - f(v - e)) / 2e-5 for e in 1e-5 * np.eye(len(v))])
    scale = 1 / np.sqrt(x.mean(0) + 1e-3)
    slope = scale * step(lambda v: loss(v, theta), w)
    assert np.abs(slope[w > 0] + l1).max() < 1e-5 and (slope[w == 0] > -l1 - 1e-6).all()
    assert np.abs(step(lambda t: loss(w, t), theta)).max() < 1e-5
    assert theta[0] < theta[1] and (w[:2] > 0.3).all()
    drawn = toxicity._cumulative_fit(rows, cols, n, m, grade, 2, l1, rounds=4000)[1]
    assert drawn[1] - drawn[0] > theta[1] - theta[0]


def test_severity_by_plain_loops(spark):
    rng = np.random.default_rng(8)
    words = [f"word{i}" for i in range(12)] + ["Vile", "slur"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(30)] + [None, "", "!!"]
    names = np.unique([f for t in texts for f in plain_features(t or "")])[::2]
    model = toxicity.Model(names.astype(np.int64), rng.random(len(names)), np.array([0.4, 1.7]))
    weights = dict(zip(names.tolist(), model.weights, strict=True))
    rows = spark.createDataFrame([(i, t, 1.0, True) for i, t in enumerate(texts)] + [(3, texts[3], 1.0, True)], "doc_id long, text string, severity double, toxic boolean")
    got = sorted(toxicity.score(rows, model).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == sorted([*range(len(texts)), 3])
    for r in got:
        z = sum(weights.get(f, 0.0) for f in plain_features(texts[r.doc_id] or ""))
        above = [1 / (1 + math.exp(t - z)) for t in model.thresholds]
        each = [1 - above[0], above[0] - above[1], above[1]]
        assert abs(r.severity - (each[1] + 2 * each[2])) < 1e-9 and r.grade == each.index(max(each)) and r.toxic == (above[0] >= 0.5)
