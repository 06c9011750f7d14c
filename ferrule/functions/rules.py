"""Scoring and decision rules as SQL expressions over named columns: `F.expr(spark(RULE))` in Spark, `duck(RULE)` in DuckDB.

The notation is SQL; LEN is an array's size, JOINED its elements as one text, HAS a regular-expression match, AGE a date's days before August 2001, @G replaces every match, @1 is the first group. Days and clocks are columns, never read from the machine.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(rule: str) -> str:
    """Numbers with a point are doubles in both engines, not decimals."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", rule)


def spark(rule: str) -> str:
    return _doubles(rule).replace("\\", "\\\\").replace("LEN(", "size(").replace("JOINED(", "array_join(").replace("HAS(", "regexp_like(").replace("AGE(", "datediff(DATE'2001-08-01', ").replace("@G", "").replace("@1", "$1").replace("@2", "$2")


def duck(rule: str) -> str:
    return _doubles(rule).replace("LEN(", "len(").replace("JOINED(", "array_to_string(").replace("HAS(", "regexp_matches(").replace("AGE(", "-date_diff('day', DATE '2001-08-01', ").replace("@G", ", 'g'").replace("@1", "\\1").replace("@2", "\\2")


def column(rule: str) -> Column:
    return F.expr(spark(rule))


def any_of(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def count_of(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({text}, '{w}') THEN 1 ELSE 0 END" for w in words) + ")"


# fixed values: word lists of the rules
LEGAL_TERMS = ["section", "article", "clause", "proviso", "explanation", "illustration", "court", "judgment", "held", "decided", "appeal", "petition", "plaintiff", "defendant", "appellant", "respondent"]
CUT_SHORT = ["...", "[truncated]", "[continued]", "(contd.)"]
INTENTS = [
    ("definition", ["what", "define", "meaning", "explain"]),
    ("procedure", ["how", "procedure", "process", "steps"]),
    ("case_law", ["case", "judgment", "ruling", "held"]),
    ("statute", ["section", "article", "act", "law"]),
    ("penalty", ["penalty", "punishment", "fine", "imprisonment"]),
]
PHRASES = [("whoever", "Whoever"), ("wherever", "Wherever"), ("whenever", "Whenever"), ("shall", "shall"), ("may", "may"), ("provided that", "Provided that"), ("provided further that", "Provided further that"), ("notwithstanding anything", "Notwithstanding anything"), ("subject to", "Subject to"), ("in respect of", "in respect of"), ("with respect to", "with respect to")]
COURTS = [("Supreme Court of India", "SC"), ("Supreme Court", "SC"), ("High Court", "HC")]

# ranking: columns score, body, kind, section, bench, and what each names
AUTHORITY = "CASE WHEN kind = 'case' THEN 1.0 + 0.05 * least(bench, 5) WHEN kind = 'statute' AND unit = 'Section' THEN 1.1 ELSE 1.0 END"
RECENCY = "CASE WHEN day IS NULL THEN 0.0 WHEN kind = 'case' THEN 1.0 / (1.0 + greatest(age / 365.0, 0.0)) WHEN kind = 'statute' THEN greatest(0.2, 1.0 / (1.0 + greatest(age / 365.0, 0.0))) ELSE 0.0 END"
STATUTE_SCORE = "0.6 * vec_norm + 0.25 * kw_norm + 0.1 * recency + 0.05 * (authority - 1.0) + CASE WHEN section_guessed THEN 0.15 ELSE 0.0 END + CASE WHEN id_guessed THEN 0.25 ELSE 0.0 END"
CASE_SCORE = "rrf + 0.20 * vec_norm + CASE WHEN apex THEN 0.15 ELSE 0.0 END + CASE WHEN years <= 10 THEN 0.05 ELSE 0.0 END + CASE WHEN topics >= 2 THEN 0.15 WHEN topics >= 1 THEN 0.10 ELSE 0.0 END + CASE WHEN bridged THEN 0.20 ELSE 0.0 END + CASE resolver WHEN 'party' THEN 0.25 WHEN 'party_or' THEN 0.10 WHEN 'fallback' THEN 0.20 ELSE 0.0 END"
CHUNK_RELEVANCE = "CASE WHEN length(body) < 50 THEN 0.0 ELSE least(1.0, score * CASE WHEN length(body) BETWEEN 200 AND 800 THEN 1.1 WHEN length(body) > 1500 THEN 0.9 ELSE 1.0 END * CASE WHEN kind IN ('statute', 'case_law') THEN 1.2 WHEN kind = 'regulation' THEN 1.1 ELSE 1.0 END * CASE WHEN section IS NOT NULL THEN 1.15 ELSE 1.0 END) END"
INTENT = "CASE " + " ".join(f"WHEN {any_of('question', words)} THEN '{name}'" for name, words in INTENTS) + " ELSE 'general' END"
INTENT_BOOST = "CASE WHEN intent = 'definition' AND part IN ('definition', 'explanation') THEN 0.1 WHEN intent = 'procedure' AND part IN ('procedure', 'process') THEN 0.1 WHEN intent = 'case_law' AND kind = 'case_law' THEN 0.08 WHEN intent = 'statute' AND kind = 'statute' THEN 0.08 WHEN intent = 'penalty' AND contains(lower(body), 'penalty') THEN 0.12 ELSE 0.0 END"
CITATION_RANK = "score + CASE WHEN verified THEN 0.2 ELSE 0.0 END + CASE WHEN kind IN ('case_law', 'statute') THEN 0.1 ELSE 0.0 END + CASE WHEN coalesce(reference, '') <> '' THEN 0.05 ELSE 0.0 END"
MEMORY = "0.5 * overlap + 0.3 * importance + 0.2 / (1.0 + hours / 24.0)"
FLOOR_BY_KIND = "CASE WHEN kind IN ('statute', 'case_law') THEN least_score - 0.05 WHEN kind = 'regulation' THEN least_score - 0.03 WHEN kind = 'user' THEN least_score + 0.1 ELSE least_score END"


def legal_boost(terms: list[str], citations: list[str]) -> str:
    """score with the boosts of matched terms and citations, of kind, part and importance; 1 at most."""
    worth = lambda t: 0.15 if "section" in t or "article" in t else 0.12 if any(a in t for a in ("ipc", "crpc", "constitution")) else 0.08
    parts = [f"CASE WHEN contains(lower(body), '{t.lower()}') THEN {w} ELSE 0.0 END" for t, w in [*((t, worth(t)) for t in terms), *((c, 0.20) for c in citations)]]
    kind = "CASE WHEN kind = 'statute' THEN 0.05 + CASE WHEN section IS NOT NULL THEN 0.03 ELSE 0.0 END WHEN kind = 'case_law' THEN 0.04 + CASE WHEN part IN ('principle', 'ratio', 'holding') THEN 0.05 ELSE 0.0 END ELSE 0.0 END"
    return f"least(1.0, score + {' + '.join([*parts, kind])} + CASE WHEN importance > 0.7 THEN importance * 0.05 ELSE 0.0 END)"


def keyword_boost(matches: list[tuple[str, float]]) -> str:
    """score with a boost for each (word, worth) that the body contains; 1 at most."""
    return "least(1.0, score + " + " + ".join(f"CASE WHEN contains(lower(body), '{w.lower()}') THEN {b} ELSE 0.0 END" for w, b in matches) + ")"


# quality of a chunk, of its text t (trimmed) and number of words and sentences
LENGTH_SCORE = "CASE WHEN length(t) BETWEEN 100 AND 2000 THEN 1.0 WHEN length(t) < 100 THEN length(t) / 100.0 ELSE greatest(0.3, 2000.0 / length(t)) END"
WHOLE_SCORE = f"greatest(0.0, 1.0 - 0.3 * {count_of('lower(t)', [*CUT_SHORT, 'see page'])})"
READ_SCORE = "CASE WHEN sentence_words BETWEEN 10 AND 30 THEN 1.0 ELSE greatest(0.3, 1.0 - abs(sentence_words - 20) / 20.0) END"
LEGAL_SCORE = f"least(1.0, {count_of('lower(t)', LEGAL_TERMS)} / 5.0)"
QUALITY = f"CASE WHEN length(t) < 10 THEN 0.0 ELSE 0.2 * ({LENGTH_SCORE}) + 0.3 * ({WHOLE_SCORE}) + 0.2 * ({READ_SCORE}) + 0.3 * ({LEGAL_SCORE}) END"
SKIP = "CASE WHEN quality < 0.3 THEN 'low quality' WHEN length(t) < 20 THEN 'too short' WHEN letters < 0.5 THEN 'few letters' END"
KEEP_SCORE = f"length(t) * 0.001 - 10.0 * {count_of('lower(t)', CUT_SHORT)} - 2.0 * artefacts + 5.0 * titled + 3.0 * sectioned + 2.0 * citations"
IMPORTANCE = "greatest(0.0, least(1.0, 0.5 + least(0.3, keywords * 0.05) + least(0.2, citations * 0.1) - CASE WHEN words < 20 THEN 0.2 WHEN words > 300 THEN 0.1 ELSE 0.0 END))"

# claims and answers
CLAIM_RISK = "least(1.0, 0.3 + 0.4 * absolute + 0.3 * uncited_number + 0.2 * recent + 0.2 * complex + CASE WHEN definitive = 1 AND absolute + uncited_number + recent + complex = 0 THEN 0.2 ELSE 0.0 END)"
RISK_LEVEL = "CASE WHEN risk >= 0.8 OR unsupported >= 0.5 THEN 'CRITICAL' WHEN risk >= 0.6 OR unsupported >= 0.3 THEN 'HIGH' WHEN risk >= 0.4 OR unsupported >= 0.1 THEN 'MEDIUM' ELSE 'LOW' END"
CITATION_FAULTS = "CASE WHEN coalesce(reference, '') = '' THEN 'missing' WHEN HAS(lower(reference), '\\b(unknown|untitled|document)\\b') THEN 'suspicious' WHEN contains(kind, 'case') AND NOT HAS(reference, '\\b[0-9]{4}\\b') THEN 'no year' WHEN contains(kind, 'case') AND NOT HAS(lower(reference), '\\bv[.]?\\s+\\w+') THEN 'no parties' END"
QUESTION_TYPE = f"CASE WHEN {any_of('question', ['compare', 'versus', 'difference between'])} THEN 'comparative' WHEN {any_of('question', ['procedure', 'process', 'how to'])} AND offences = 0 THEN 'procedural' WHEN contains(question, 'difference') OR question LIKE 'how%' THEN 'procedural' WHEN offences > 0 OR contains(question, 'punishment') OR contains(question, 'sentence') THEN 'factual' WHEN words < 4 AND terms = 0 THEN 'ambiguous' ELSE 'factual' END"
CLARIFY = "CASE WHEN type IN ('procedural', 'ambiguous') AND offences = 0 AND guesses = 0 THEN 'which offence or section' WHEN type = 'comparative' AND offences < 2 THEN 'which two' END"
REFUSE = "words < 3 AND terms = 0 AND offences = 0"
COMPLEXITY = "CASE WHEN words > 20 THEN 'complex' WHEN words > 10 THEN 'moderate' ELSE 'simple' END"
LINE_TYPE = "CASE WHEN (upper(l) = l AND lower(l) <> l AND length(l) > 5) OR HAS(l, '^[0-9]+[.]\\s+[A-Z]') THEN 'heading' WHEN HAS(l, '[A-Z][a-z]+ v[.] [A-Z][a-z]+') THEN 'citation' WHEN HAS(l, '^[0-9]+\\s+') AND length(l) < 200 THEN 'footnote' WHEN HAS(l, '^[(\\[]?[a-z0-9]+[)\\]]\\s+') THEN 'list_item' ELSE 'body' END"

# texts
PLAIN_SIGNS = "replace(replace(replace(replace(replace(replace(replace(replace(t, 'ﬁ', 'fi'), 'ﬂ', 'fl'), '–', '-'), '—', '-'), '‘', ''''), '’', ''''), '“', '\"'), '”', '\"')"
NORMAL_CITATION = "regexp_replace(regexp_replace(t, '\\s+vs?[.]\\s+', ' v. '@G), '(?i)\\s+versus\\s+', ' v. '@G)"
for _long, _short in COURTS:
    NORMAL_CITATION = f"regexp_replace({NORMAL_CITATION}, '(?i){_long}', '{_short}'@G)"
STANDARD = "t"
for _from, _to in PHRASES:
    STANDARD = f"regexp_replace({STANDARD}, '(?i)\\b{_from}\\b', '{_to}'@G)"
PAGE_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(t, '(?m)^\\s*(Page )?[0-9]+\\s*$', ''@G), '([a-z])-\\n([a-z])', '@1@2'@G), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', ''@G))"
ESCAPED = "replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
FILE_NAME = "substring(regexp_replace(t, '[^A-Za-z0-9._-]+', '_'@G), 1, 100)"
IS_UUID = "HAS(lower(t), '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$')"
IS_PHONE = "HAS(t, '^[+]?[0-9][0-9 -]{7,14}$')"
DEVANAGARI = "CASE WHEN length(t) = 0 THEN 'en' WHEN LEN(regexp_extract_all(t, '[\\x{0900}-\\x{097F}]', 0)) * 1.0 / length(t) > 0.1 THEN 'hi' ELSE 'en' END"

# fixed values: patterns of claims in a lower-cased sentence, and what makes them risky
QUANTITY = r"\b[0-9]+\s+(days|months|years|percent|rupees)\b"
CLAIMS = {
    "definitive": r"\b(the|this)\s+(law|act|section|court|judgment)\s+(states?|holds?|provides?|establishes?)\b|\b(according\s+to|under|as\s+per)\s+(section|article|the\s+act)\b|\b(the\s+supreme\s+court|high\s+court)\s+(held|ruled|decided|observed)\b|\bis\s+(mandatory|prohibited|required|illegal|valid|invalid)\s+under\b|\b(shall|must|cannot|may\s+not)\s+.*(under|according\s+to)\b",
    "case_law": r"\bin\s+the\s+case\s+of\b|\bthe\s+court\s+in\b",
    "statutory": r"\bsection\s+[0-9]+|\barticle\s+[0-9]+|\bunder\s+the\s+\w+\s+act\b",
    "procedural": r"\bprocedure|process|filing|application|petition\b",
    "quantitative": QUANTITY,
}
ABSOLUTE = ["always", "never", "all cases", "in every situation", "without exception", "guaranteed", "certainly", "definitely will", "impossible", "absolutely"]
RECENT = ["recently", "latest", "new", "current", "2024", "2025"]
INTERPRETING = ["interpretation", "implies", "suggests", "indicates", "likely means"]
#: Words of which a sentence holds one at least if it makes the claim: they are sought first, as most sentences have none.
CLAIM_WORDS = {"definitive": ["law", "act", "section", "court", "judgment", "article", "under", "according"], "case_law": ["case", "court"], "statutory": ["section", "article", "under"], "procedural": ["procedure", "process", "filing", "application", "petition"], "quantitative": ["days", "months", "years", "percent", "rupees"]}
CLAIM_FLAGS = {name: f"HAS(s, '{pattern}')" for name, pattern in CLAIMS.items()}
RISK_FLAGS = {"absolute": any_of("s", ABSOLUTE), "uncited_number": rf"HAS(s, '{QUANTITY}') AND NOT HAS(s, '\[doc[0-9]+\]|\[[0-9]+\]')", "recent": any_of("s", RECENT), "interpreting": any_of("s", INTERPRETING)}
