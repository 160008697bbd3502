"""Structured Streaming jobs, each with a batch twin in the operators."""
