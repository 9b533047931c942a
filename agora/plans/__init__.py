"""Whole plans: the enrichment of a corpus, and the registered queries with their SQL."""
