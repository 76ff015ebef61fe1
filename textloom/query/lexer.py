"""Query text to tokens."""

from __future__ import annotations

import re
from typing import NamedTuple

#: Names of filters, and words that stand for a value.
FIELDS = ("filename", "filepath", "file", "extension", "ext", "language", "lang", "complexity", "path")
ALIASES = ("high", "medium", "low")


class Token(NamedTuple):
    kind: str
    text: str


_FIELD = "(?:" + "|".join(FIELDS) + ")"
# A value behind `field:` may hold slashes and ends at an operator; elsewhere a word may hold "!", unless what stands before is a field.
_TOKEN = re.compile(
    rf"""
    (?P<SPACE>\s+)
  | "(?P<PHRASE>[^"]*)(?:"|\Z)
  | /(?P<REGEX>[^/]*)(?:/|\Z)
  | (?P<OPERATOR>!=|>=|<=|[=!<>])
  | (?P<LPAREN>\()
  | (?P<RPAREN>\))
  | (?P<COMMA>,)
  | (?P<WORD>{_FIELD}:[^\s()",=!<>]* | {_FIELD}(?=!) | [^\s()",=!<>/][^\s()",=<>/]*)
    """,
    re.VERBOSE | re.IGNORECASE,
)


def is_field(text: str) -> bool:
    return text.lower() in FIELDS


def _word(text: str) -> Token:
    if text.upper() in ("AND", "OR", "NOT"):
        return Token(text.upper(), text)
    if text.lower() in ALIASES:
        return Token("ALIAS", text)
    if text.isdecimal():
        return Token("NUMBER", text)
    if len(text) > 2 and text[-2] == "~" and text[-1] in "12":
        return Token("FUZZY", text)
    return Token("WORD", text)


def tokens(query: str) -> list[Token]:
    """All tokens of a query but white space, ended by one of kind END."""
    out = []
    for m in _TOKEN.finditer(query):
        kind = m.lastgroup
        if kind == "WORD":
            out.append(_word(m["WORD"]))
        elif kind != "SPACE":
            out.append(Token(kind, m[kind]))
    return [*out, Token("END", "")]
