"""Operators for large training-data pipelines.

Nothing outside this folder imports it.  Every operator takes DataFrames and
returns DataFrames; the thin ``opN_*`` queries are in :mod:`quire.llm.queries`.
"""
