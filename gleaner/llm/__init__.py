"""Operators for preparing training text at table scale.

Each module holds one operator with its general interface; ``queries`` registers the
thin ``opN_`` queries over the given tables. Nothing outside this subpackage (and
``corpus_pipeline.py``) imports it.
"""
