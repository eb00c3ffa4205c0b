"""Structured Streaming jobs and the batch forms of the same plans."""
