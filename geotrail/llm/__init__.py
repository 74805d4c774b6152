"""Operators of a large-scale training-data pipeline, each a DataFrame-to-DataFrame function.

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
