"""Structured Streaming drivers of the same operators."""
