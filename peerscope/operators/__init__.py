"""Operators over peer groups, shapes, gates and profiles."""
