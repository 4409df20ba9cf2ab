"""Structured Streaming jobs: live tracks, display stabiliser, progress, sessions, artifact ingest."""
