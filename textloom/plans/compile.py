"""A query's tree as one boolean Column, or as a chain of filters with the cheapest first."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.matching import fuzzy
from textloom.functions.patterns import glob_regex, has_glob, java_regex, path_glob_regex
from textloom.query.nodes import And, Filter, Fuzzy, Keyword, Node, Not, Or, Phrase, Regex
from textloom.query.rewrite import COST, conjuncts

Handler = Callable[[str, object], Column]


def _values(value: object, kind: type) -> list:
    return [v for v in (value if isinstance(value, tuple) else (value,)) if isinstance(v, kind)]


def _negated(found: Column, operator: str) -> Column:
    return found if operator == "=" else ~found


def _one_of(column: str) -> Handler:
    def handler(operator: str, value: object) -> Column:
        if isinstance(value, int):
            return F.lit(False)
        return _negated(F.lower(column).isin([v.lower() for v in _values(value, str)]), operator)

    return handler


def _file(operator: str, value: object) -> Column:
    if isinstance(value, int):
        return F.lit(False)
    name = F.lower("filename")

    def one(v: str) -> Column:
        if not has_glob(v):
            return F.contains(name, F.lit(v.lower()))
        made = glob_regex(v.lower())
        return F.lit(False) if made is None else name.rlike(r"\A(?:" + made + r")\z")

    found = [one(v) for v in _values(value, str)]
    return _negated(reduce(Column.__or__, found) if found else F.lit(False), operator)


def _path(operator: str, value: object) -> Column:
    if operator not in ("=", "!=") or not isinstance(value, str):
        return F.lit(False)
    path = F.lower("path")
    if not has_glob(value):
        return _negated(F.contains(path, F.lit(value.lower())), operator)
    made = path_glob_regex(value.lower())
    return _negated(F.lit(False) if made is None else path.rlike(made), operator)


def _complexity(operator: str, value: object) -> Column:
    c = F.col("complexity")
    test = {"=": lambda v: c == v, "!=": lambda v: c != v, ">=": lambda v: c >= v, "<=": lambda v: c <= v}.get(operator)
    found = [test(F.lit(v)) for v in _values(value, int)] if test else []
    return reduce(Column.__or__, found) if found else F.lit(False)


#: What each filter does; more can be registered with an engine.
HANDLERS: dict[str, Handler] = {
    "complexity": _complexity,
    "lang": _one_of("language"),
    "language": _one_of("language"),
    "ext": _one_of("extension"),
    "extension": _one_of("extension"),
    "file": _file,
    "filename": _file,
    "path": _path,
    "filepath": _path,
}


class Compiler:
    """Trees as Columns over documents (path, filename, language, extension, content, complexity), none of them null."""

    def __init__(self, sensitive: bool = False, handlers: dict[str, Handler] | None = None, content: str = "content"):
        self.sensitive, self.handlers, self.content = sensitive, HANDLERS | (handlers or {}), content

    def literal(self, value: str) -> Column:
        if not value:
            return F.lit(True)
        if self.sensitive:
            return F.contains(self.content, F.lit(value))
        return F.contains(F.lower(self.content), F.lit(value.lower()))

    def near(self, value: str, distance: int) -> Column:
        """What all texts with a fuzzy term hold: one of distance + 1 pieces of the term, since an edit spoils one at most.
        A term that isn't ASCII, or is too short for pieces, tells nothing."""
        count = distance + 1
        if not value.isascii() or len(value) < count:
            return F.lit(True)
        cuts = [len(value) * i // count for i in range(count + 1)]
        found = [self.literal(value[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        return reduce(or_, found)

    def column(self, node: Node | None) -> Column:
        match node:
            case None:
                return F.lit(True)
            case And(left, right):
                return self.column(left) & self.column(right)
            case Or(left, right):
                return self.column(left) | self.column(right)
            case Not(inner):
                return ~self.column(inner)
            case Keyword(value) | Phrase(value):
                return self.literal(value)
            case Regex(pattern):
                made = java_regex(pattern)
                return F.lit(False) if made is None else F.col(self.content).rlike(made)
            case Fuzzy(value, distance):
                if not value:
                    return F.lit(False)
                # lower-casing may lengthen a text, so that only a far shorter one is out of question
                likely = (3 * F.octet_length(self.content) >= len(value.encode())) & self.near(value, distance)
                # other texts aren't sent to Python, wherever in the tree this stands
                return likely & fuzzy(F.when(likely, F.col(self.content)), value, distance, self.sensitive)
            case Filter(field, operator, value):
                handler = self.handlers.get(field.lower())
                return F.lit(False) if handler is None else handler(operator, value)
        raise TypeError(f"not a node: {node!r}")

    def filtered(self, docs: DataFrame, node: Node | None) -> DataFrame:
        """docs where the tree holds. Conjuncts become filters in order of cost, and Python runs after all that is built in."""
        if node is None:
            return docs
        for part in sorted(conjuncts(node), key=lambda n: (_python(n), COST.get(type(n), 1000))):
            docs = docs.where(self.column(part))
        return docs


def _python(node: Node) -> bool:
    match node:
        case And(left, right) | Or(left, right):
            return _python(left) or _python(right)
        case Not(inner):
            return _python(inner)
    return isinstance(node, Fuzzy)
