"""Structured Streaming variants of the batch stages."""
