"""Operators of a training-data pipeline: duplicates, sharding, fingerprints, mixing, classifiers.

Nothing else in the library imports this subpackage.
"""
