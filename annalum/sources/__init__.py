"""Readers of the file formats, and sinks that change tables without a MERGE."""
