"""Structured Streaming: settling inboxes, keyed state, and incremental tables."""
