"""Streaming ingest of new samples into a cohort (an addition of this engine)."""
