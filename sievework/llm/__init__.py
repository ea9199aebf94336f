"""Operators that prepare text corpora for language-model training.

Nothing else in the package imports this subpackage. Every operator takes and
returns DataFrames; the registered queries of ``queries.py`` are thin callers.
"""
