"""Postings, scores, lines, snippets and the shaping of results."""
