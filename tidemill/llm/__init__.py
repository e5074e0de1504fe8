"""Operators for large-scale training-data preparation.

Nothing else in the package imports this subpackage; it can be removed as a
whole (with ``corpus_pipeline.py`` and ``tests/llm``).
"""
