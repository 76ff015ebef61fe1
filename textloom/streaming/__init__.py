"""Searches over streams of documents."""
