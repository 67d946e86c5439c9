"""Structured Streaming: page ingestion and processing status."""
