"""Structured Streaming form of the per-key event features."""
