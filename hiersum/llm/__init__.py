"""Operators for preparing training corpora.

Nothing outside this subpackage imports it.  Each operator lives in a module
of its own with a general interface; ``queries.py`` holds the thin contract
queries that reduce an operator's real output to digest columns.
"""
