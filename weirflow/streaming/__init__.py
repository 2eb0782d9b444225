"""Streaming CDC: files of change batches merged into versioned tables."""
