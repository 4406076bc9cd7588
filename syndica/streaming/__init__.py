"""Structured Streaming jobs: ingestion, de-duplication and feed state."""
