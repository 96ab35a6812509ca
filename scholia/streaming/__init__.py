"""Structured Streaming forms of the rate, job and review rules."""
