"""Readers of source files and sinks of results."""
