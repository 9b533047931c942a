"""Structured Streaming: ingest with first-write-wins tables, and event-time summaries."""
