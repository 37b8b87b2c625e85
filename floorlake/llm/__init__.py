"""Operators of a training-data pipeline: documents, web pages, embeddings and token ids."""
