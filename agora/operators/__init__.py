"""DataFrame operators: ingest, stage caches, model stages, extraction, and analytics."""
