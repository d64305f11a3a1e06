"""Incremental (Structured Streaming) form of the activity timeline."""
