"""Operators that prepare text collections for language-model training.

Nothing else in the package imports this subpackage.
"""
