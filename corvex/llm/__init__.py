"""Operators for preparing training data from large text collections.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
