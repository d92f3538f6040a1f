"""Operators for training-data pipelines: text statistics, deduplication, packing and archives.

Nothing else in the library imports this subpackage; deleting it leaves the
modelling engine whole.
"""
