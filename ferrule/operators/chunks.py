"""Chunkers: text to rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.text import token_estimate, word_set


def word_windows(docs: DataFrame, key: str, text: str, size: int = 500, step: int = 450, least: int = 50) -> DataFrame:
    """Overlapping windows of words; those of `least` characters or fewer go. A row carries its own window alone."""
    words = docs.select(key, F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ").alias("w"))
    windows = F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step)), lambda at: F.array_join(F.slice("w", at + 1, size), " "))
    return words.select(key, F.posexplode(windows).alias("chunk", "text")).where(F.length("text") > least)


def token_gate(chunks: DataFrame, text: str, low: int = 80, high: int = 800) -> DataFrame:
    """chunks with tokens and the reason to drop each (null: keep)."""
    n = token_estimate(F.col(text))
    return chunks.withColumn("tokens", n).withColumn("reason", F.when(n < low, "too_short").when(n > high, "too_long"))


def line_segments(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Every line with its number and the place at which it starts: a running sum over a document's lines. Each row needs a key of its own."""
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "content"))
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(key, "line", F.coalesce(F.sum(F.length("content") + 1).over(before), F.lit(0)).cast("int").alias("start"), "content")


def _pack(pieces: Column, start: Column, most: int, alone: Callable[[Column, Column], Column]) -> Column:
    """Folds pieces into (done, cur): cur takes pieces until it would have more than `most` characters, joining blanks not counted; `alone` says what a piece does that finds cur empty and has more."""

    def step(a: Column, s: Column) -> Column:
        closed = F.struct(F.concat(a["done"], F.array(F.trim(a["cur"]))).alias("done"), s.alias("cur"))
        grown = F.struct(a["done"].alias("done"), F.when(a["cur"] == "", s).otherwise(F.concat(a["cur"], F.lit(" "), s)).alias("cur"))
        return F.when(F.length(a["cur"]) + F.length(s) <= most, grown).when(a["cur"] != "", closed).otherwise(alone(a, s))

    return F.aggregate(pieces, start, step)


def sentence_chunks(docs: DataFrame, key: str, text: str, most: int = 500) -> DataFrame:
    """Sentences gathered until a chunk would pass `most` characters: one ordered fold for each document. A first sentence longer than that is split by words."""
    word = lambda a, w: F.struct(F.concat(a["done"], F.array(w)).alias("done"), a["cur"].alias("cur"))  # noqa: E731  a longer word is a chunk of its own
    split = lambda a, s: _pack(F.filter(F.split(s, r"\s+"), lambda w: w != ""), a, most, word)
    empty = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("cur"))
    folded = docs.select(key, _pack(F.split(text, r"(?<=[.!?])\s+"), empty, most, split).alias("f"))
    whole = F.concat(F.col("f.done"), F.when(F.col("f.cur") != "", F.array(F.trim("f.cur"))).otherwise(F.expr("cast(array() as array<string>)")))
    return folded.select(key, F.posexplode(whole).alias("chunk", "text"))


#: Rows of whole texts that Spark sends to Python at once, and those that are cut before their chunks go back.
SENT, CUT = 1000, 32


def _cut(docs: DataFrame, key: str, text: str, cutter: Callable[[str], list[str]]) -> DataFrame:
    """key, chunk and text of what cutter makes of each text; a null text has no chunks. The session's Arrow batches are lowered to SENT rows, and a few texts at a time are held as Python's."""
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= SENT:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(SENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CUT):
                b = whole.slice(at, CUT)
                made = [cutter(t) if t else [] for t in b.column(1).to_pylist()]
                n = [len(m) for m in made]
                rows = pa.array([i for i, k in enumerate(n) for _ in range(k)], pa.int64())
                nth = pa.array([i for k in n for i in range(k)], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), nth, pa.array([c for m in made for c in m], pa.string())], [key, "chunk", "text"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, chunk int, text string")


def _size(text: str) -> int:
    return len(text) // 4


def _runs(pieces: list[str], weigh: Callable[[str], int], joint: int, most: int, keep: Callable[[list[str]], list[str]] | None = None) -> list[list[str]]:
    """Pieces in runs: a run ends before the piece with which it would weigh more than `most`, joints between pieces included, and the next one opens with what `keep` takes from its end."""
    made: list[list[str]] = []
    run, size = [], -joint
    for piece in pieces:
        own = joint + weigh(piece)
        if run and size + own > most:
            made.append(run)
            run = list(keep(run)) if keep else []
            size = sum(joint + weigh(p) for p in run) - joint
        run.append(piece)
        size += own
    return [*made, run] if run else made


def _room(tokens: int) -> int:
    """The most characters that are estimated as so many tokens."""
    return 4 * tokens + 3


def _sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]


def paragraph_windows(docs: DataFrame, key: str, text: str, target: int = 500, least: int = 80, most: int = 800, overlap: int = 80) -> DataFrame:
    """Paragraphs (between blank lines, 20 characters or more) packed into chunks of `least` to `most` estimated tokens.

    A chunk closes at `target` tokens, or if the next paragraph would take it past target + 100, but not below target - 100 while that still fits `most`. The next
    chunk opens with the end of the last one: `overlap` tokens, or fewer if the next paragraph is long; nothing follows the last paragraph. A paragraph that would
    take a chunk past `most` is split by sentences, a longer sentence by length. A chunk below `least` joins the one before, or goes if both don't fit.
    """

    def cut(document: str) -> list[str]:
        made: list[str] = []

        def add(chunk: str) -> None:
            chunk = chunk.strip()
            if _size(chunk) >= least:
                made.append(chunk)
            elif len(chunk) >= 20 and made and _size(made[-1]) + _size(chunk) + 1 <= most:
                made[-1] = f"{made[-1]}\n\n{chunk}"

        def add_long(paragraph: str) -> None:
            pieces = [s[i : i + 4 * most] for s in _sentences(paragraph) for i in range(0, len(s), 4 * most)]
            for run in _runs(pieces, len, 2, _room(most)):
                add("\n\n".join(run))

        paragraphs = [p for p in map(str.strip, re.split(r"\n\s*\n", document)) if len(p) >= 20]
        held = ""
        for paragraph, after in zip_longest(paragraphs, paragraphs[1:]):
            grown = f"{held}\n\n{paragraph}" if held else paragraph
            if _size(grown) > most:
                if held:
                    add(held)
                add_long(paragraph)
                held = ""
                continue
            held = grown
            size, coming = _size(grown), None if after is None else _size(f"{grown}\n\n{after}")
            if (size >= target or (coming or 0) > target + 100) and not (size < target - 100 and (coming or most + 1) <= most):
                add(held)
                room = 0 if after is None or not made else min(overlap, target + 20 - _size(after))
                held = made[-1][-4 * room :].strip() if room > 0 else ""
        if held:
            add(held)
        return made

    return _cut(docs, key, text, cut)


def case_paragraphs(docs: DataFrame, key: str, text: str, most: int = 1000) -> DataFrame:
    """Paragraphs between blank lines, packed while they have `most` estimated tokens; a longer paragraph is a chunk of its own."""
    return _cut(docs, key, text, lambda d: ["\n\n".join(r) for r in _runs([p for p in map(str.strip, d.split("\n\n")) if p], len, 2, _room(most))])


def overlapping_sentences(docs: DataFrame, key: str, text: str, most: int = 1000, again: int = 2) -> DataFrame:
    """Sentences packed while they have `most` estimated tokens; a chunk opens with the last `again` sentences of the one before."""
    return _cut(docs, key, text, lambda d: [" ".join(r) for r in _runs(_sentences(d), len, 1, _room(most), lambda r: r[-again:])])


#: What is taken out of a judgment before it is cut.
NOISE = [r"(?i)SUPREME COURT REPORTS.*?\n", r"Page \d+ of \d+", r"\[.*?\]"]


def judgment_chunks(docs: DataFrame, key: str, text: str, target: int = 800, hard: int = 1800, overlap: int = 75, again: int = 3, lines: bool = True) -> DataFrame:
    """Paragraphs packed to `target` estimated tokens; a chunk opens with the last sentences of the one before, `again` sentences and `overlap` tokens at most.

    A paragraph of more than `hard` tokens is cut by sentences, each run up to `hard`; a sentence longer than that is cut by words if it opens its run, else it stays whole. Without `lines` the
    cleaning collapses line breaks too, so a judgment is one paragraph.
    """

    def by_sentence(paragraph: str) -> list[str]:
        made: list[str] = []
        run, size = [], 0
        for sentence in re.split(r"(?<=[.!?])\s+", paragraph):
            own = _size(sentence)
            if size + own <= hard:
                run.append(sentence)
                size += own
            elif run:
                made.append(" ".join(run))
                run, size = [sentence], own
            else:
                made += [" ".join(r) for r in _runs(sentence.split(), _size, 0, hard)]
        return [*made, " ".join(run)] if run else made

    def tail(chunk: str) -> list[str]:
        kept: list[str] = []
        for sentence in reversed(re.split(r"(?<=[.!?])\s+", chunk)[-again:]):
            if sum(map(_size, kept)) + _size(sentence) > overlap:
                break
            kept.insert(0, sentence)
        return [" ".join(kept)] if kept else []

    def cut(document: str) -> list[str]:
        for noise in NOISE:
            document = re.sub(noise, "", document)
        document = re.sub(r"(\w)-\s*\n\s*(\w)", r"\1\2", document)
        document = re.sub(r"[^\S\n]+" if lines else r"\s+", " ", document).strip()
        made: list[str] = []
        held, size = "", 0
        for paragraph in (p.strip() for p in re.split(r"\n\s*\n|\n\s*\(\d+\)\s*", document)):
            own = _size(paragraph)
            if not paragraph:
                continue
            if own > hard:
                made += [*([held] if held else []), *by_sentence(paragraph)]
                held, size = "", 0
            elif size + own > target:
                made += [held] if held else []
                held = "\n\n".join([*(tail(held) if held else []), paragraph])
                size = _size(held)
            else:
                held = f"{held}\n\n{paragraph}" if held else paragraph
                size += own
        return [c.strip() for c in ([*made, held] if held else made)]

    return _cut(docs, key, text, cut)


def statute_sections(docs: DataFrame, key: str, text: str, most: int = 800) -> DataFrame:
    """Sections that begin with a number and a point; a longer one is cut at its illustrations, explanations and provisos, else at sentences, and packed again."""

    def cut(document: str) -> list[str]:
        made: list[str] = []
        for section in (s for s in map(str.strip, re.split(r"\n\s*(?=\d+\.)", document)) if s):
            if _size(section) <= most:
                made.append(section)
                continue
            parts, between = re.split(r"\n\s*(?=(?:Illustration|Explanation|Proviso))", section), "\n\n"
            if len(parts) == 1:
                parts, between = _sentences(section), " "
            made += [between.join(r).strip() for r in _runs(parts, _size, 0, most)]
        return made

    return _cut(docs, key, text, cut)


# fixed values: headings that part a judgment, in the order in which they're tried, and marks inside a section
HEADINGS = [r"\bJUDGMENT\b", r"\bORDER\b", r"\bHELD\s*:", r"\bFACTS\s*:", r"\bCONCLUSION\s*:", r"\bDISPOSAL\s*:"]
MARKS = [r"\d+\.\s+", r"\([a-z]\)\s+", r"\([ivx]+\)\s+"]


def judgment_sections(docs: DataFrame, key: str, text: str, most: int = 6000, overlap: int = 200) -> DataFrame:
    """Texts of 50 characters or more parted at the first heading that occurs and gives a chunk; sections over `most` characters are packed again from parts between marks, else from sentences.

    Sections of 100 characters or fewer go, as do packed chunks of 50 or fewer. Parts are repeated by overlap / 10 words, sentences by `overlap` words.
    """
    last = lambda count: lambda run: [" ".join(" ".join(run).split()[-count:])] if count else []
    long = lambda chunks: [c for c in map(str.strip, chunks) if len(c) > 50]

    def by_sentence(section: str) -> list[str]:
        pieces = [s for s in map(str.strip, re.split(r"[.!?]+\s+", section)) if s]
        return long(" ".join(r) for r in _runs(pieces, len, 1, most + 1, last(overlap)))

    def by_mark(section: str) -> list[str]:
        if len(section) <= most:
            return [section.strip()]
        mark = next((m for m in MARKS if re.search(m, section)), None)
        if mark is None:
            return by_sentence(section)
        return long(" ".join(r) for r in _runs(re.split(f"(?={mark})", section), len, 1, most, last(overlap // 10)))

    def cut(document: str) -> list[str]:
        flat = re.sub(r"\s+", " ", document.strip())
        if len(flat) < 50:
            return []
        for heading in HEADINGS:
            sections = re.split(f"(?={heading})", flat, flags=re.IGNORECASE) if re.search(heading, flat, re.IGNORECASE) else []
            if made := [c for s in sections if len(s) > 100 for c in by_mark(s)]:
                return made
        return by_sentence(flat)

    return _cut(docs, key, text, cut)


def parsed_lines(docs: DataFrame, key: str, text: str, section: str = "^([0-9]+[A-Z]?)[.].+—.+") -> DataFrame:
    """key, section (its running number), number, unit (0: the section's own lines), unit_type and text: trimmed lines grouped under numbered headings (a dash after the title) and, inside these, under illustrations, explanations and provisos.

    Lines before the first heading go, as do blank ones. Each row needs a key of its own.
    """
    line = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "l")).withColumn("l", F.trim("l")).where("l <> ''")
    kind = F.when(F.rlike("l", F.lit("(?i)^illustration")), "Illustration").when(F.rlike("l", F.lit("(?i)^explanation")), "Explanation").when(F.rlike("l", F.lit("(?i)^(proviso|provided)")), "Proviso")
    before = lambda *of: Window.partitionBy(key, *of).orderBy("line")
    told = line.select("*", F.rlike("l", F.lit(section)).alias("opens"), kind.alias("kind"))
    told = told.withColumn("section", F.count_if("opens").over(before())).where("section > 0").withColumn("unit", F.count_if(F.isnotnull("kind") & ~F.col("opens")).over(before("section")))
    own = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "l"))), lambda x: x["l"]), c)
    units = told.groupBy(key, "section", "unit").agg(F.max(F.when(F.col("opens"), F.regexp_extract("l", section, 1))).alias("number"), F.max("kind").alias("unit_type"), own("\n").alias("text"))
    return units.select(key, "section", "number", "unit", F.coalesce(F.when(F.col("unit") > 0, F.col("unit_type")), F.lit("Section")).alias("unit_type"), "text")


def near_in_document(docs: DataFrame, key: str, text: str, percent: int = 95) -> DataFrame:
    """Every line (chunk) with kept: false if an earlier kept line of its document has the same words or a word set with Jaccard similarity percent / 100 or more. Lines without words are kept; a null text has none.

    A document's lines are all in its row, so nothing is shuffled: a line meets the kept ones of its document that share one of its first words in order (of two sets so similar, each has one among its
    n - ceil(percent * n / 100) + 1 first), and of these those of like size.
    """
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= SENT:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(SENT))

    def told(lines: list[list[str]]) -> list[bool]:
        out, same, first = [], set(), {}
        for words in lines:
            own, n = frozenset(words), len(words)
            known = own in same
            if n and not known:
                same.add(own)
                heads = words[: n - (percent * n + 99) // 100 + 1]
                known = any(100 * min(n, len(s)) >= percent * max(n, len(s)) and 100 * len(own & s) >= percent * len(own | s) for w in heads for s in first.get(w, ()))
                if not known:
                    for w in heads:
                        first.setdefault(w, []).append(own)
            out.append(not known)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CUT):
                b = whole.slice(at, CUT)
                kept = [told(lines or []) for lines in b.column(1).to_pylist()]
                ids = b.column(0).take(pa.array([i for i, k in enumerate(kept) for _ in k], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([c for k in kept for c in range(len(k))], pa.int32()), pa.array([x for k in kept for x in k], pa.bool_())], [key, "chunk", "kept"])

    words = F.transform(F.split(text, "\n"), lambda line: F.array_sort(F.filter(word_set(line), lambda w: w != "")))
    return docs.select(key, words.alias("words")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, chunk int, kept boolean")
