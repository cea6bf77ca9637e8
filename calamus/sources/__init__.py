"""Readers and writers of corpora, name tables and result tables."""
