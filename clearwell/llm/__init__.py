"""Operators of a training-data pipeline over documents, vectors, pages and conversations.

Nothing outside this package imports it. ``queries.py`` holds the registered queries and their SQL.
"""
