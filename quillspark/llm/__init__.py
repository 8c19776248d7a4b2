"""Operators for preparing training data: filters, scores, duplicates, mixing and packing.

Nothing else in the package imports this subpackage.
"""
