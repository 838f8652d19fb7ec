"""Operators for training corpora: deduplication, classifiers, tokens, mixing, search.

Nothing else in the library imports this package.
"""
