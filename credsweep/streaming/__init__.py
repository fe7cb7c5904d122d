"""Structured Streaming: scan documents as they arrive."""
