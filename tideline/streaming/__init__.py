"""Structured Streaming forms of the stateful operators and of the jobs."""
