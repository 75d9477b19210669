"""Training-data operators: search, scoring, deduplication, mixing and packing.

Nothing outside this subpackage, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
