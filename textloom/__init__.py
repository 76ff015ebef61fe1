"""Ranked text and code search, and corpus preparation, as DataFrame operations."""
