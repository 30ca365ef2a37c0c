"""Operators for preparing training data: documents, pages, conversations and vectors."""
