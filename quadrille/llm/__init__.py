"""Operators of a training-data pipeline: filters, deduplication, scoring, mixing.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
