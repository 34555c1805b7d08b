"""Structured Streaming: audit on arrival, evidence from a feedback log, deduplicated feedback."""
