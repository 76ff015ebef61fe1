"""Tokens to a tree. OR binds least, then AND, then terms side by side; NOT takes the next term or group."""

from __future__ import annotations

from textloom.query.lexer import Token, is_field, tokens
from textloom.query.nodes import And, Filter, Fuzzy, Keyword, Node, Not, Or, Phrase, Regex
from textloom.query.rewrite import hoisted

AND_DEFAULT, OR_DEFAULT = "and", "or"
_STARTS = {"WORD", "PHRASE", "REGEX", "FUZZY", "LPAREN", "NOT"}
_TIGHTEST = 5


class InvalidQueryError(ValueError):
    """A query that has text but no meaning."""


class _Parser:
    def __init__(self, query: str, default: str):
        self.rest = tokens(query)[::-1]
        self.default = default
        self.open = 0
        self.notices: list[str] = []

    @property
    def now(self) -> Token:
        return self.rest[-1]

    @property
    def after(self) -> Token:
        return self.rest[-2] if len(self.rest) > 1 else self.rest[-1]

    def take(self) -> Token:
        return self.rest.pop() if len(self.rest) > 1 else self.rest[-1]

    def strength(self) -> int:
        kind = self.now.kind
        return {"OR": 1, "AND": 2}.get(kind, 3 if kind in _STARTS else 0)

    def expression(self, floor: int = 0) -> Node | None:
        left = self.primary()
        while left is not None and (strength := self.strength()) > floor:
            kind = self.now.kind
            if kind in ("AND", "OR"):
                if self.after.kind in ("END", "RPAREN"):
                    break  # nothing follows: the query's end reports it
                self.take()
            right = self.expression(strength)
            if right is None:
                if kind not in ("AND", "OR"):
                    self.notices.append("Notice: A term that has no meaning was ignored.")
                    break
            elif kind == "OR":
                left = Or(left, right)
            elif kind == "AND" or self.default == AND_DEFAULT:
                left = And(left, right)
            else:
                left = Or(left, right, implicit=True)
        return left

    def primary(self) -> Node | None:
        kind, text = self.now
        if kind == "WORD":
            return self.word()
        if kind == "NOT":
            self.take()
            inner = self.expression(_TIGHTEST)
            return None if inner is None else Not(inner)
        if kind == "LPAREN":
            self.take()
            self.open += 1
            inner = hoisted(self.expression())
            if self.now.kind == "RPAREN":
                self.take()
                self.open -= 1
            return inner
        if kind == "RPAREN":
            self.notices.append("Notice: Unmatched ')' was ignored.")
            self.take()
            return self.primary()
        made = {"NUMBER": Keyword, "PHRASE": Phrase, "REGEX": Regex}.get(kind)
        if made is None and kind != "FUZZY":
            return None
        self.take()
        return Fuzzy(text[:-2], int(text[-1])) if kind == "FUZZY" else made(text)

    def word(self) -> Node | None:
        text = self.now.text
        field, colon, value = text.partition(":")
        if colon and is_field(field):
            if value:
                self.take()
                if value.isdecimal() and field.lower() == "complexity":
                    self.notices.append(f"Notice: '{text}' compares text and matches nothing; write '{field}={value}'.")
                if self.now.kind == "COMMA":
                    self.notices.append(f"Notice: A list of values needs an operator: write '{field}={value},...'.")
                return Filter(field.lower(), "=", value)
            if self.after.kind == "OPERATOR":
                return self.filter(field)
        elif self.after.kind == "OPERATOR" and is_field(text):
            return self.filter(text)
        return Keyword(self.take().text)

    def filter(self, field: str) -> Node | None:
        self.take()
        operator = self.take().text
        values: list[str | int] = []
        while True:
            if self.now.kind == "NUMBER":
                values.append(int(self.take().text))
            elif self.now.kind in ("ALIAS", "WORD", "PHRASE"):
                values.append(self.take().text)
            if self.now.kind != "COMMA":
                break
            self.take()
        if not values:
            return None
        return Filter(field.lower(), operator, values[0] if len(values) == 1 else tuple(values))


def parse(query: str, default: str = AND_DEFAULT) -> tuple[Node | None, list[str]]:
    """The tree of a query (None if there is none) and what was ignored or added on the way."""
    if default not in (AND_DEFAULT, OR_DEFAULT):
        raise ValueError(f"no such default operator: {default}")
    p = _Parser(query, default)
    if p.now.kind == "END":
        return None, []
    node = p.expression()
    if p.now.kind in ("AND", "OR"):
        p.notices.append(f"Warning: Trailing '{p.now.text}' was ignored.")
    elif p.now.kind == "RPAREN":
        p.notices.append("Notice: Unmatched ')' was ignored.")
    elif p.now.kind != "END":
        p.notices.append(f"Notice: The query from '{p.now.text}' on was ignored.")
    if p.open:
        p.notices.append("Notice: Missing ')' was added to the end of the query.")
    return node, p.notices
