"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its general interface; ``queries.py`` holds the thin registered
queries.
"""
