"""Operators of a training-data pipeline: deduplication, tokenising, quality, packing, search.

One module per operator; ``queries`` registers one query per operator. Nothing else in the
library imports this package.
"""
