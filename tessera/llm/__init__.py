"""Operators for training-data pipelines over documents, pages and embeddings.

Nothing else in the package imports this subpackage; its named queries are in
``tessera.llm.queries``.
"""
