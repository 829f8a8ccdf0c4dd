"""Structured Streaming: append-only logs taken in as they grow. Windows over event time are an extension."""
