"""Rewrites of a query's tree, and what is read off it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from textloom.query.nodes import And, Filter, Fuzzy, Keyword, Node, Not, Or, Phrase, Regex

#: What evaluating a node costs against others, and words for numbers.
COST = {Filter: 10, Keyword: 20, Phrase: 25, Regex: 50, Fuzzy: 50, Or: 100, Not: 110}
REGISTERED = {("complexity", "high"): (">=", 8)}


class QueryLimitError(ValueError):
    """A query longer, or of more terms, than allowed."""


@dataclass(frozen=True)
class Limits:
    """Most bytes and most distinct terms of a query; 0 for no limit."""

    length: int = 1000
    terms: int = 50

    def check_length(self, query: str) -> None:
        if self.length and len(query.encode()) > self.length:
            raise QueryLimitError(f"query is longer than {self.length} bytes")

    def check_terms(self, node: Node | None) -> None:
        if self.terms and (n := len(counted_terms(node))) > self.terms:
            raise QueryLimitError(f"query has {n} terms; at most {self.terms} are allowed")


#: Limits for queries that a tool composes.
TOOL_LIMITS = Limits(250, 12)


def _parted(node: Node | None) -> tuple[Node | None, list[Filter]]:
    if isinstance(node, Filter):
        return None, [node]
    if isinstance(node, Or) and node.implicit:
        (a, fa), (b, fb) = _parted(node.left), _parted(node.right)
        both = Or(a, b, implicit=True) if a is not None and b is not None else a if b is None else b
        return both, fa + fb
    return node, []


def hoisted(node: Node | None) -> Node | None:
    """Filters among terms side by side under OR constrain all of those terms instead."""
    rest, filters = _parted(node)
    parts = [x for x in (rest, *filters) if x is not None]
    return reduce(And, parts) if parts else None


def aliases_expanded(node: Node | None, notices: list[str], registered: dict[tuple[str, str], tuple[str, int]] = REGISTERED) -> Node | None:
    """Filters whose value is a word for a number, with the comparison that it stands for."""
    if isinstance(node, And | Or):
        left, right = aliases_expanded(node.left, notices, registered), aliases_expanded(node.right, notices, registered)
        return And(left, right) if isinstance(node, And) else Or(left, right, node.implicit)
    if isinstance(node, Not):
        return Not(aliases_expanded(node.inner, notices, registered))
    if isinstance(node, Filter) and isinstance(node.value, str) and (meant := registered.get((node.field.lower(), node.value.lower()))):
        notices.append(f"Notice: '{node.field}{node.operator}{node.value}' was interpreted as '{node.field} {meant[0]} {meant[1]}'.")
        return Filter(node.field, *meant)
    return node


def conjuncts(node: Node) -> Iterator[Node]:
    if isinstance(node, And):
        yield from conjuncts(node.left)
        yield from conjuncts(node.right)
    else:
        yield node


def ordered(node: Node | None) -> Node | None:
    """Conjunctions with the cheapest first, nested to the right."""
    if isinstance(node, And):
        parts = sorted(map(ordered, conjuncts(node)), key=lambda n: COST.get(type(n), 1000))
        return reduce(lambda right, left: And(left, right), reversed(parts))
    if isinstance(node, Or):
        return Or(ordered(node.left), ordered(node.right), node.implicit)
    if isinstance(node, Not):
        return Not(ordered(node.inner))
    return node


def positive(node: Node | None) -> Iterator[Node]:
    """Leaves outside NOT, but filters, in order."""
    if isinstance(node, And | Or):
        yield from positive(node.left)
        yield from positive(node.right)
    elif isinstance(node, Keyword | Phrase | Regex | Fuzzy):
        yield node


def text_of(node: Node) -> str:
    return node.pattern if isinstance(node, Regex) else node.value


def terms(node: Node | None) -> list[str]:
    """What to highlight: positive terms in order, repeats kept."""
    return [text_of(n) for n in positive(node)]


def counted_terms(node: Node | None) -> set[str]:
    """Distinct terms that count against a limit: all leaves, and text values of filters."""
    if isinstance(node, And | Or):
        return counted_terms(node.left) | counted_terms(node.right)
    if isinstance(node, Not):
        return counted_terms(node.inner)
    if isinstance(node, Filter):
        return {node.value} if isinstance(node.value, str) else set()
    return set() if node is None else {text_of(node)}


def prepared(query: str, default: str = "and", limits: Limits | None = None, registered: dict | None = None) -> tuple[Node | None, list[str]]:
    """From text to the tree that is compiled: parsed, hoisted, within limits, aliases expanded, ordered."""
    from textloom.query.parser import parse

    limits = limits or Limits(0, 0)
    limits.check_length(query)
    node, notices = parse(query, default)
    node = hoisted(node)
    limits.check_terms(node)
    return ordered(aliases_expanded(node, notices, REGISTERED | (registered or {}))), notices


def compose(query: str, path: str = "", file: str = "") -> str:
    """A query that all of the side filters (comma-separated; any of each) constrain."""
    groups = []
    for field, raw in (("path", path), ("file", file)):
        values = [f"{field}:{v.strip()}" for v in raw.split(",") if v.strip()]
        if values:
            groups.append(values[0] if len(values) == 1 else f"({' OR '.join(values)})")
    return f"({query}) {' '.join(groups)}" if groups else query


def anded_keywords(query: str) -> list[str] | None:
    """The positive keywords of a query that only ANDs and has two or more, else None."""
    from textloom.query.parser import parse

    node, _ = parse(query)
    found: list[str] = []

    def walk(n: Node | None, wanted: bool) -> bool:
        if isinstance(n, Or):
            return False
        if isinstance(n, And):
            return all([walk(n.left, wanted), walk(n.right, wanted)])
        if isinstance(n, Not):
            return walk(n.inner, not wanted)
        if isinstance(n, Keyword) and wanted:
            found.append(n.value)
        return True

    return found if walk(node, True) and len(found) > 1 else None


def hint_for_no_results(query: str) -> str | None:
    """Advice for a query of several terms that found nothing."""
    words = anded_keywords(query)
    if not words:
        return None
    return f"Nothing holds every one of the {len(words)} terms ({', '.join(words)}), which are ANDed. Leave some out, or ask for any of them: '{' OR '.join(words)}'."
