"""Operators for preparing large text corpora (de-duplication, filtering, packing).

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
