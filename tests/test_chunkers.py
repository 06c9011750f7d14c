"""Every chunker against its rule written as a plain loop over strings, on the whole table and on texts made for the edges."""

from __future__ import annotations

import random
import re

import pytest

from ferrule.operators import chunks
from tests.conftest import SF


def size(t):
    return len(t) // 4


def packed(pieces, fits, keep=lambda run: []):
    """A run ends before the piece with which its whole joined text wouldn't fit."""
    made, run = [], []
    for piece in pieces:
        if run and not fits([*run, piece]):
            made.append(run)
            run = keep(run)
        run = [*run, piece]
    return [*made, run] if run else made


def sentences(t):
    return [s for s in re.split(r"(?<=[.!?])\s+", t) if s.strip()]


def plain_case(t):
    return ["\n\n".join(r) for r in packed([p for p in map(str.strip, t.split("\n\n")) if p], lambda r: size("\n\n".join(r)) <= 1000)]


def plain_overlapping(t):
    return [" ".join(r) for r in packed(sentences(t), lambda r: size(" ".join(r)) <= 1000, lambda r: r[-2:])]


def plain_statute(t):
    out = []
    for section in re.split(r"\n\s*(?=\d+\.)", t):
        section = section.strip()
        if not section:
            continue
        if size(section) <= 800:
            out.append(section)
            continue
        parts = re.split(r"\n\s*(?=(?:Illustration|Explanation|Proviso))", section)
        if len(parts) == 1:
            out += [" ".join(r).strip() for r in packed(sentences(section), lambda r: sum(map(size, r)) <= 800)]
        else:
            out += ["\n\n".join(r).strip() for r in packed(parts, lambda r: sum(map(size, r)) <= 800)]
    return out


def plain_sections(t):
    flat = re.sub(r"\s+", " ", t.strip())
    if len(flat) < 50:
        return []

    def by_sentence(section):
        pieces = [s for s in map(str.strip, re.split(r"[.!?]+\s+", section)) if s]
        joined = [" ".join(r).strip() for r in packed(pieces, lambda r: len(" ".join(r)) <= 6001, lambda r: [" ".join(" ".join(r).split()[-200:])])]
        return [c for c in joined if len(c) > 50]

    for heading in (r"\bJUDGMENT\b", r"\bORDER\b", r"\bHELD\s*:", r"\bFACTS\s*:", r"\bCONCLUSION\s*:", r"\bDISPOSAL\s*:"):
        starts = [0, *[m.start() for m in re.finditer(heading, flat, re.IGNORECASE)], len(flat)]
        made = []
        for a, b in zip(starts, starts[1:]) if len(starts) > 2 else ():
            section = flat[a:b]
            if len(section) <= 100:
                continue
            mark = next((m for m in (r"\d+\.\s+", r"\([a-z]\)\s+", r"\([ivx]+\)\s+") if re.search(m, section)), None)
            if len(section) <= 6000:
                made.append(section.strip())
            elif mark is None:
                made += by_sentence(section)
            else:
                joined = [" ".join(r).strip() for r in packed(re.split(f"(?={mark})", section), lambda r: len(" ".join(r)) <= 6000, lambda r: [" ".join(" ".join(r).split()[-20:])])]
                made += [c for c in joined if len(c) > 50]
        if made:
            return made
    return by_sentence(flat)


def plain_judgment(t, lines=True):
    t = re.sub(r"SUPREME COURT REPORTS.*?\n", "", t, flags=re.IGNORECASE)
    t = re.sub(r"\[.*?\]", "", re.sub(r"Page \d+ of \d+", "", t))
    t = re.sub(r"(\w)-\s*\n\s*(\w)", r"\1\2", t)
    t = re.sub(r"[^\S\n]+", " ", t).strip() if lines else re.sub(r"\s+", " ", t).strip()
    out, current, tokens = [], "", 0
    for p in re.split(r"\n\s*\n|\n\s*\(\d+\)\s*", t):
        p = p.strip()
        if not p:
            continue
        if size(p) > 1800:
            out += [current.strip()] if current else []
            current, tokens = "", 0
            inner, n = "", 0
            for s in re.split(r"(?<=[.!?])\s+", p):
                if n + size(s) > 1800:
                    if inner:
                        out.append(inner.strip())
                        inner, n = s, size(s)
                    else:
                        words, w = "", 0
                        for word in s.split():
                            if w + size(word) > 1800 and words:
                                out.append(words)
                                words, w = "", 0
                            words, w = f"{words} {word}" if words else word, w + size(word)
                        out += [words] if words else []
                else:
                    inner, n = f"{inner} {s}" if inner else s, n + size(s)
            out += [inner.strip()] if inner else []
        elif tokens + size(p) > 800:
            opened = ""
            if current:
                out.append(current.strip())
                n = 0
                for s in reversed(re.split(r"(?<=[.!?])\s+", current)[-3:]):
                    if n + size(s) > 75:
                        break
                    opened, n = f"{s} {opened}" if opened else s, n + size(s)
            current = f"{opened}\n\n{p}" if opened else p
            tokens = size(current)
        else:
            current, tokens = f"{current}\n\n{p}" if current else p, tokens + size(p)
    return [*out, current.strip()] if current else out


def made():
    rng = random.Random(4)
    words = ["facts", "order", "held:", "Judgment", "1. ", "(a) ", "law", "court", "page", "Page 3 of 9", "[note]", "over-\nlap"]
    between = [" ", " ", " ", ". ", ".\n", "\n\n", "\n(2) ", "\n3. ", "\nIllustration ", "! "]
    out = []
    for n in (0, 1, 5, 40, 400, 2500, 6000):
        for _ in range(4):
            out.append("".join(rng.choice(words) + "x" * rng.randrange(9) + rng.choices(between, weights=[9, 9, 9, 3, 1, 1, 1, 1, 1, 1])[0] for _ in range(n)))
    return [*out, "", None, "word " * 5000, "x" * 9000, "x" * 9000 + ". end.", "A sentence. " + "y" * 9000, "\n\n\n", "JUDGMENT short", "FACTS: " + "z " * 60 + "ORDER"]


CASES = [
    (chunks.case_paragraphs, {}, plain_case),
    (chunks.overlapping_sentences, {}, plain_overlapping),
    (chunks.statute_sections, {}, plain_statute),
    (chunks.judgment_sections, {}, plain_sections),
    (chunks.judgment_chunks, {}, plain_judgment),
    (chunks.judgment_chunks, {"lines": False}, lambda t: plain_judgment(t, False)),
]


@pytest.mark.parametrize("cutter, options, plain", CASES)
def test_chunks_by_plain_loops(spark, cutter, options, plain):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = table + [(10**6 + i, t) for i, t in enumerate(made())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {}
    for r in cutter(df, "doc_id", "text", **options).collect():
        got.setdefault(r.doc_id, {})[r.chunk] = r.text
    for i, t in rows:
        own = got.get(i, {})
        assert [own[k] for k in range(len(own))] == (plain(t) if t else []), (i, (t or "")[:80])
