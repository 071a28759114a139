"""Operators for training-data pipelines: texts, token sequences, embeddings, conversations.

Nothing else in the library imports this subpackage.
"""
