"""Structured Streaming: tailing transcripts, upserts and windows."""
