"""Readers and writers for corpora, dictionaries, vectors and sense-induction data."""
