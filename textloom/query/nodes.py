"""The tree of a query. Nodes are immutable and print in a canonical form."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Union

Value = Union[str, int, tuple["str | int", ...]]


@dataclass(frozen=True)
class Keyword:
    value: str

    def __str__(self) -> str:
        return f"KEYWORD({self.value})"


@dataclass(frozen=True)
class Phrase:
    value: str

    def __str__(self) -> str:
        return f'PHRASE("{self.value}")'


@dataclass(frozen=True)
class Regex:
    pattern: str

    def __str__(self) -> str:
        return f"REGEX(/{self.pattern}/)"


@dataclass(frozen=True)
class Fuzzy:
    value: str
    distance: int

    def __str__(self) -> str:
        return f"FUZZY({self.value}~{self.distance})"


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: Value

    def __str__(self) -> str:
        shown = "[" + " ".join(map(str, self.value)) + "]" if isinstance(self.value, tuple) else self.value
        return f"FILTER({self.field} {self.operator} {shown})"


@dataclass(frozen=True)
class And:
    left: Node
    right: Node

    def __str__(self) -> str:
        return f"({self.left} AND {self.right})"


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node
    #: Made by two terms side by side, not written.
    implicit: bool = False

    def __str__(self) -> str:
        return f"({self.left} OR {self.right})"


@dataclass(frozen=True)
class Not:
    inner: Node

    def __str__(self) -> str:
        return f"NOT {self.inner}"


Node = Union[Keyword, Phrase, Regex, Fuzzy, Filter, And, Or, Not]
