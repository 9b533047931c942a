"""Readers and writers: the corpus, landed API responses, media files, and stage tables."""
