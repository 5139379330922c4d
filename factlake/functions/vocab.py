"""Fixed word lists and the patterns built from them."""

from __future__ import annotations

import functools
import html.entities
import os
import re

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the source behaviour for identical results).
# Portuguese connectives used to cut a text into clauses, in their original
# order.  Order matters: alternation is leftmost-first, so an earlier short
# form ("logo", "assim", "pois", "ou", "se") shadows a later long form
# ("logo que", "assim que", ...).  "..." is three literal dots.
CONNECTIVES = [
    "e", "nem", "também", "bem como", "não só...mas", "também", "mas", "porém",
    "contudo", "todavia", "entretanto", "no entanto", "não obstante", "ou",
    "ou...ou", "já...já", "ora...ora", "quer...quer", "seja...seja", "logo",
    "pois", "portanto", "assim", "por isso", "por consequência",
    "por conseguinte", "porque", "que", "porquanto", "visto que", "uma vez que",
    "já que", "pois que", "como", "tanto que", "tão que", "tal que",
    "tamanho que", "de forma que", "de modo que", "de sorte que",
    "de tal forma que", "a fim de que", "para que", "quando", "enquanto",
    "agora que", "logo que", "desde que", "assim que", "apenas", "se", "caso",
    "desde", "salvo se", "exceto se", "contanto que", "embora", "conquanto",
    "ainda que", "mesmo que", "se bem que", "posto que", "assim como", "tal",
    "qual", "tanto como", "conforme", "consoante", "segundo",
    "à proporção que", "à medida que", "ao passo que", "quanto mais...mais",
]
# Sentence marks that also end a clause (clause split) and the terminator of
# the after-"que" clause.
CLAUSE_MARKS = "[.!?]"
QUE_TERMINATOR = r"\."
# Word that opens an after-"que" clause.
QUE_WORD = "que"
# Part-of-speech tags that form a noun phrase.
NOUN_PHRASE_TAGS = ["N", "NPROP", "ADJ"]
# Text-column candidates for column inference, in priority order.
TEXT_COLUMN_CANDIDATES = ["sentence", "text", "utterance", "claim", "statement",
                          "Sentence", "Text", "Utterance", "Claim", "Statement"]
# Label vocabularies.
GOLD_FACTUAL = ["factual", "fact", "true"]
GOLD_NON_FACTUAL = ["non-factual", "nonfactual", "not-factual", "false", "fake"]
THREE_CLASS_LABELS = ["non-factual", "factual-non-important", "factual-checkworthy"]
THREE_CLASS_NON_FACTUAL = ["não factual", "nao factual", "non-factual", "nf", "0",
                           "-1", "non factual"]
THREE_CLASS_NON_IMPORTANT = ["factual não importante", "factual nao importante",
                             "factual-non-important", "fni", "1"]
BINARY_POSITIVE = ["1", "true", "factual", "fact", "fato", "verdadeiro"]
BINARY_NEGATIVE = ["0", "false", "non-factual", "nonfactual", "nao-factual",
                   "não-factual", "fake", "boato", "falso"]
# Prompt prefix for generative summarisers.
SUMMARY_PROMPT = "Summarize the following text: "
# ---------------------------------------------------------------------------


def _alternative_regex(phrase: str) -> str:
    return re.escape(phrase).replace("\\ ", " ")


def html_entities() -> dict:
    """The named entities of HTML 4, plus ``apos``: name to character."""
    return {**{name: chr(code) for name, code in html.entities.name2codepoint.items()}, "apos": "'"}


def connective_group() -> str:
    """``(alt1|alt2|...)`` with literal dots escaped."""
    return "(" + "|".join(_alternative_regex(p) for p in CONNECTIVES) + ")"


def _whole_connective() -> str:
    """Java regex of a connective as a whole word, group 1.  Alternatives with one first letter stand together
    in their order, as no other letter's can match there, and a place is first asked for such a letter."""
    by_letter = {}
    for p in CONNECTIVES:
        by_letter.setdefault(p[0], []).append(_alternative_regex(p[1:]))
    group = "|".join(f"{k}(?:{'|'.join(rest)})" for k, rest in by_letter.items())
    return rf"(?=[{''.join(by_letter)}])\b({group})\b"


def clause_pattern_java(marks: str = CLAUSE_MARKS, case_insensitive: bool = False) -> str:
    """Java regex: a connective as a whole-word group 1, or a mark (no group)."""
    flags = "(?iU)" if case_insensitive else "(?U)"
    return flags + _whole_connective() + "|" + marks


def after_que_pattern_java(terminator: str = QUE_TERMINATOR) -> str:
    """Java regex whose group 1 is the clause after the word ``que`` up to the
    next connective or terminator (case-insensitive, dot matches newline)."""
    stop = _whole_connective() + "|" + terminator
    return r"(?isU)\b" + QUE_WORD + r"\b\s*(.*?)(?=\s*(?:" + stop + "))"


@functools.lru_cache(maxsize=None)
def stop_words(language: str = "portuguese") -> tuple:
    """The fixed stop-word list of ``language`` (Spark ML's public lists, kept
    as one word per line under ``stopwords/``), in its natural order."""
    path = os.path.join(os.path.dirname(os.path.abspath(__file__)), "stopwords", f"{language}.txt")
    with open(path, encoding="utf-8") as f:
        return tuple(w for w in f.read().split("\n") if w)
