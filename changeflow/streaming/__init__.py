"""Structured Streaming: target tables, the apply pipeline and windowed metrics."""
