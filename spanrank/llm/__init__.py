"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage; its queries are listed in
:mod:`spanrank.llm.queries` and their DuckDB twins in :mod:`spanrank.llm.sql`.
"""
