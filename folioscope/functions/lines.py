"""What a line of a page looks like: one reading of its signs, and line kinds as rules over them."""
from __future__ import annotations

import enum
import re
from functools import lru_cache
from typing import NamedTuple

# ---- fixed values: the signs by which a line is taken for a table row, code, an algorithm or mathematics ----
GAP = r" {2,}|\t{1,}"
WORD = r"\b[A-Za-z]{2,}\b"
RULE_ROW = r"\s*\|?(?:\s*:?-{2,}:?\s*\|)+\s*:?-{2,}:?\s*\|?\s*$"
CELL_ROW = r"\s*[^|]{0,80}(?:\|[^|]{0,80}){2,}\s*$"
OPERATORS = ["::=", ":=", "->", "<-", "{", "}", "[", "]"]
STEP = r"(?i)\s*(?:\d+\.|\(\d+\)|Step\s+\d+[:.]|Algorithm\s+\d+[:.])"
CONTRACT = r"(?i)\s*(?:Input|Output|Require|Ensure|Given)[:\s]"
LATEX = r"\$|\\[()\[\]]"
SYMBOLS = "=<>±×÷∑∏∈∉≈≡≤≥⊕⊗"
FUNCTION = r"(?i)\b(?:mod|log|gcd|lcm)\b"
RELATION = r"\b[A-Za-z]\s*[=<>]\s*[A-Za-z0-9]\b"
ALGORITHM = r"(?i)\s*(?:Algorithm|Input|Output|Require|Ensure)\b"
ALGORITHM_PART = r"(?i)\s*(?:(?:Algorithm|Input|Output|Require|Ensure)\b|Step\s+\d+|[0-9]+\.)"
NUMBERED = r"\s*[0-9]+\s*:\s*"
#: Longest cell of a row without outer bars, words of an aligned row, and words from which one symbol is an example in a sentence.
CELL_WIDTH, ROW_WORDS, SENTENCE_WORDS = 80, 24, 12


class Sign(enum.IntFlag):
    """What can be seen in one line."""

    TEXT = enum.auto()
    INDENT = enum.auto()
    OPERATOR = enum.auto()
    OPENING = enum.auto()  # a step or a contract word
    LATEX = enum.auto()
    SYMBOL = enum.auto()
    FORMULA = enum.auto()  # symbols enough to be no example in a sentence
    RULE = enum.auto()
    BARRED = enum.auto()  # three bars, the first one first
    FIRST_BAR = enum.auto()
    BARS = enum.auto()
    CELLS = enum.auto()
    NARROW = enum.auto()  # cells that hold no sentence
    GAPS = enum.auto()
    COLUMNS = enum.auto()  # three gaps between few words
    NO_TABLE = enum.auto()
    STARTS_ALGORITHM = enum.auto()
    NUMBERED = enum.auto()


class Kind(NamedTuple):
    """A kind of line: one sign of ``some``, and none of ``none``; a line without text is of no kind."""

    some: Sign
    none: Sign = Sign(0)


KINDS = {
    # chunking
    "table": Kind(Sign.RULE | Sign.BARRED | Sign.NARROW, Sign.NO_TABLE),
    "aligned": Kind(Sign.RULE | Sign.BARRED | Sign.CELLS | Sign.COLUMNS, Sign.NO_TABLE),
    "math": Kind(Sign.LATEX | Sign.FORMULA),
    "algorithm": Kind(Sign.STARTS_ALGORITHM | Sign.INDENT | Sign.OPERATOR | Sign.OPENING | Sign.LATEX | Sign.FORMULA),
    # chunking and cleaning
    "code": Kind(Sign.INDENT | Sign.OPERATOR | Sign.OPENING),
    # cleaning
    "rows": Kind(Sign.FIRST_BAR | Sign.BARS | Sign.GAPS),
    "symbols": Kind(Sign.LATEX | Sign.SYMBOL),
}
KINDS["verbatim"] = Kind(KINDS["rows"].some | KINDS["code"].some | KINDS["symbols"].some)

_GAP, _WORD, _RULE_ROW, _CELL_ROW, _LATEX = map(re.compile, (GAP, WORD, RULE_ROW, CELL_ROW, LATEX))
_OPENING = re.compile(f"(?i)(?:{STEP.removeprefix('(?i)')})|(?:{CONTRACT.removeprefix('(?i)')})")
_OPERATOR = re.compile("|".join(map(re.escape, OPERATORS)))
_SYMBOL, _FUNCTION, _RELATION = re.compile(f"[{SYMBOLS}]"), re.compile(FUNCTION), re.compile(RELATION)
_ALGORITHM_PART, _NUMBERED, _SENTENCE_MARK = re.compile(ALGORITHM_PART), re.compile(NUMBERED), re.compile(r"[.!?;:]\s")


def _bars(body: str) -> Sign:
    """The signs of a line that has bars."""
    seen, n = Sign(0), body.count("|")
    outer = body[0] == "|"
    for yes, sign in ((n > 1, Sign.BARS), (outer, Sign.FIRST_BAR), (outer and n >= 3, Sign.BARRED), (_RULE_ROW.match(body), Sign.RULE), (not outer and "||" in body, Sign.NO_TABLE)):
        if yes:
            seen |= sign
    if n >= 3 and _CELL_ROW.match(body):
        widths = [len(c.strip()) for c in body.split("|") if c.strip()]
        seen |= Sign.CELLS
        if len(widths) >= 3 and max(widths) <= CELL_WIDTH and not _SENTENCE_MARK.search(body):
            seen |= Sign.NARROW
    return seen


def _symbols(line: str, words: int) -> Sign:
    """The signs of a line that has mathematical symbols: two different ones make a formula, a single one needs a short line and a relation."""
    different = len(set(_SYMBOL.findall(line)))
    if not different:
        return Sign(0)
    formula = different > 1 or (words < SENTENCE_WORDS and (_FUNCTION.search(line) or _RELATION.search(line)))
    return Sign.SYMBOL | Sign.FORMULA if formula else Sign.SYMBOL


@lru_cache(maxsize=1 << 15)
def read(line: str) -> Sign:
    """All signs of a line."""
    body = line.strip()
    if not body:
        return Sign(0)
    words, gaps = len(_WORD.findall(line)), len(_GAP.findall(line))
    inner = len(_GAP.findall(line.rstrip()))
    seen = Sign.TEXT | _symbols(line, words)
    if "|" in body:
        seen |= _bars(body)
    for yes, sign in (
        (line[0] == "\t" or line[:4] == "    ", Sign.INDENT), (_OPERATOR.search(line), Sign.OPERATOR), (_OPENING.match(line), Sign.OPENING), (_LATEX.search(line), Sign.LATEX), (gaps > 1, Sign.GAPS),
        (inner > 2 and words <= ROW_WORDS, Sign.COLUMNS), ("$$" in body or "\\dots" in body, Sign.NO_TABLE), (_ALGORITHM_PART.match(line), Sign.STARTS_ALGORITHM), (_NUMBERED.match(line), Sign.NUMBERED),
    ):
        if yes:
            seen |= sign
    return seen


def is_kind(line: str, kind: str) -> bool:
    seen, rule = read(line), KINDS[kind]
    return bool(seen & rule.some) and not seen & rule.none
