"""The query language: text to tokens, tokens to a tree, and rewrites of the tree. Runs on the driver only."""

from textloom.query.nodes import And, Filter, Fuzzy, Keyword, Node, Not, Or, Phrase, Regex
from textloom.query.parser import AND_DEFAULT, OR_DEFAULT, InvalidQueryError, parse
from textloom.query.rewrite import QueryLimitError, Limits, aliases_expanded, compose, counted_terms, hint_for_no_results, hoisted, ordered, prepared, terms

__all__ = ["AND_DEFAULT", "OR_DEFAULT", "And", "Filter", "Fuzzy", "InvalidQueryError", "Keyword", "Limits", "Node", "Not", "Or", "Phrase", "QueryLimitError", "Regex", "aliases_expanded", "compose", "counted_terms", "hint_for_no_results", "hoisted", "ordered", "parse", "prepared", "terms"]
