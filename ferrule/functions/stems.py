"""Porter's stemmer: one table of rules, as SQL steps that run on a column in any engine, and as a Python function for Arrow passes.

Tokens are lower-cased runs of [a-z0-9]. Digits count as consonants.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The published algorithm's word shapes and suffixes.
CONSONANTS, VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
HAS_VOWEL = f"^({CONSONANTS})?[aeiouy]"
ONE_OR_MORE = f"^({CONSONANTS})?{VOWELS}{CONSONANTS}"
EXACTLY_ONE = f"^({CONSONANTS})?{VOWELS}{CONSONANTS}({VOWELS})?$"
TWO_OR_MORE = f"^({CONSONANTS})?{VOWELS}{CONSONANTS}{VOWELS}{CONSONANTS}"
SHORT = f"^{CONSONANTS}[aeiouy][^aeiouwxy]$"
PAST, ION = "^(.+?)(ed|ing)$", "^(.+?[st])(ion)$"
PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
DERIVED = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
SHORTENED = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
DROPPED = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
#: Words that full text leaves out (their places still count).
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)


def _suffix(names: list[str] | dict[str, str]) -> str:
    return f"^(.+?)({'|'.join(names)})$"


def _case(names: dict[str, str], of: str) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items()) + " END"


def steps(like: str = "regexp_like") -> list[str]:
    """Expressions over the column w, each to be applied to the one before it; `like` names the engine's function for a match anywhere."""
    has = lambda x, p: f"{like}({x}, '{p}')"
    head, tail = (lambda p: f"regexp_extract(w, '{p}', 1)"), (lambda p: f"regexp_extract(w, '{p}', 2)")

    def swapped(names: dict[str, str], shape: str | None) -> str:
        p = _suffix(names)
        met = has("w", p) + (f" AND {has(head(p), shape)}" if shape else "")
        return f"CASE WHEN {met} THEN {head(p)} || {_case(names, tail(p))} ELSE w END"

    gone = PAST
    bare = "left(w, length(w) - 1)"
    doubled = " OR ".join(f"right({bare}, 2) = '{c}{c}'" for c in "bcdfghjkmnpqrtvwx0123456789")
    mended = f"CASE WHEN {has(bare, '(at|bl|iz)$')} THEN {bare} || 'e' WHEN {doubled} THEN left(w, length(w) - 2) WHEN {has(bare, EXACTLY_ONE)} AND {has(bare, SHORT)} THEN {bare} || 'e' ELSE {bare} END"
    # a word that lost its ending is marked, as only those are mended
    past = f"CASE WHEN {has('w', '^.+eed$')} THEN CASE WHEN {has('left(w, length(w) - 3)', ONE_OR_MORE)} THEN left(w, length(w) - 1) ELSE w END WHEN {has('w', gone)} AND {has(head(gone), HAS_VOWEL)} THEN {head(gone)} || '+' ELSE w END"
    dropped, ion = _suffix(DROPPED), ION
    last = f"CASE WHEN {has('w', ion)} THEN CASE WHEN {has(head(ion), TWO_OR_MORE)} THEN {head(ion)} ELSE w END WHEN {has('w', dropped)} AND {has(head(dropped), TWO_OR_MORE)} THEN {head(dropped)} ELSE w END"
    return [
        "CASE WHEN left(w, 1) = 'y' THEN 'Y' || substring(w, 2) ELSE w END",
        swapped(PLURALS, None),
        past,
        f"CASE WHEN right(w, 1) = '+' THEN {mended} ELSE w END",
        f"CASE WHEN right(w, 1) = 'y' AND {has(bare, HAS_VOWEL)} THEN {bare} || 'i' ELSE w END",
        swapped(DERIVED, ONE_OR_MORE),
        swapped(SHORTENED, ONE_OR_MORE),
        last,
        f"CASE WHEN right(w, 1) = 'e' AND ({has(bare, TWO_OR_MORE)} OR {has(bare, EXACTLY_ONE)} AND NOT {has(bare, SHORT)}) THEN {bare} ELSE w END",
        f"CASE WHEN right(w, 2) = 'll' AND {has('w', TWO_OR_MORE)} THEN {bare} ELSE w END",
        "CASE WHEN left(w, 1) = 'Y' THEN 'y' || substring(w, 2) ELSE w END",
    ]


def stem_sql(relation: str, like: str = "regexp_matches") -> str:
    """SQL that gives term and stem for a relation's distinct column term (DuckDB's dialect unless told otherwise)."""
    out = f"SELECT term, term AS w FROM {relation} WHERE length(term) > 2"
    for i, step in enumerate(steps(like)):
        out = f"SELECT term, {step} AS w FROM ({out}) s{i}"
    return f"SELECT term, w AS stem FROM ({out}) done UNION ALL SELECT term, term FROM {relation} WHERE length(term) <= 2"


def stems(terms: DataFrame) -> DataFrame:
    """term and stem of every row of terms (a column term, best distinct)."""
    df = terms.select("term", F.col("term").alias("w"))
    for step in steps():
        df = df.withColumn("w", F.when(F.length("term") > 2, F.expr(step)).otherwise(F.col("w")))
    return df.select("term", F.col("w").alias("stem"))


_P = {p: re.compile(p) for p in (HAS_VOWEL, ONE_OR_MORE, EXACTLY_ONE, TWO_OR_MORE, SHORT, PAST, ION, "(at|bl|iz)$")}
_ENDINGS = {id(names): (tuple(names), re.compile(_suffix(names))) for names in (PLURALS, DERIVED, SHORTENED, DROPPED)}


def _cut(w: str, names: list[str] | dict[str, str]) -> re.Match | None:
    """The word's match of one of the endings; the pattern is tried only if the word has one."""
    ends, pattern = _ENDINGS[id(names)]
    return pattern.match(w) if w.endswith(ends) else None


def _swap(w: str, names: dict[str, str], shape: str | None) -> str:
    m = _cut(w, names)
    return m[1] + names[m[2]] if m and (shape is None or _P[shape].search(m[1])) else w


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of one word, by the same rules."""
    if len(word) <= 2:
        return word
    has = lambda p, x: _P[p].search(x)
    w = "Y" + word[1:] if word[0] == "y" else word
    w = _swap(w, PLURALS, None)
    if len(w) > 3 and w.endswith("eed"):
        w = w[:-1] if has(ONE_OR_MORE, w[:-3]) else w
    elif w.endswith(("ed", "ing")) and (m := _P[PAST].match(w)) and has(HAS_VOWEL, m[1]):
        w = m[1]
        if has("(at|bl|iz)$", w):
            w += "e"
        elif w[-2:-1] == w[-1] and w[-1] not in "aeiouylsz":
            w = w[:-1]
        elif has(EXACTLY_ONE, w) and has(SHORT, w):
            w += "e"
    if w.endswith("y") and has(HAS_VOWEL, w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, DERIVED, ONE_OR_MORE), SHORTENED, ONE_OR_MORE)
    if w.endswith("ion") and (m := _P[ION].match(w)):
        w = m[1] if has(TWO_OR_MORE, m[1]) else w
    elif (m := _cut(w, DROPPED)) and has(TWO_OR_MORE, m[1]):
        w = m[1]
    if w.endswith("e") and (has(TWO_OR_MORE, w[:-1]) or has(EXACTLY_ONE, w[:-1]) and not has(SHORT, w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and has(TWO_OR_MORE, w):
        w = w[:-1]
    return "y" + w[1:] if w[0] == "Y" else w
