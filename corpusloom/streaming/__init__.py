"""Structured Streaming forms of the log roll-ups; additions to the batch operators."""
