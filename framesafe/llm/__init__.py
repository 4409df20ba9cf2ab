"""Operators for preparing training data from documents, pages and embeddings; nothing else in the library imports them."""
