"""Chunk-at-a-time routines as Structured Streaming queries."""
