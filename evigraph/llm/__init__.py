"""Operators of a training-data pipeline over documents, pages and conversations.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
