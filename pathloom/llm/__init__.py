"""Operators that prepare text corpora for language-model training.

Nothing outside this folder imports it; it can be removed without touching the
rest of the package.
"""
