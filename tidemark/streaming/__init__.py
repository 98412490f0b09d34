"""Structured Streaming: publishing, dedup and sketches over micro-batches."""
