"""Entries as they arrive: the stateless operators on Structured Streaming."""
