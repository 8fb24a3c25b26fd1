"""Analyses, their bindings to the test tables, and the registry of queries."""
