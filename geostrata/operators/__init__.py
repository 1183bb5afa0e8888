"""Operators over objects, as compositions of DataFrame operations."""
