"""Operators for preparing language-model training data.

Nothing else in the package imports from here; the folder can be removed as a
whole.
"""
