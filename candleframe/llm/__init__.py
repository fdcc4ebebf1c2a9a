"""Operators of a training-data pipeline: de-duplication, tokens, search, classifiers, scans.

Nothing else in the library imports this subpackage.
"""
