"""Operators of a large-scale text-data pipeline; nothing else in the library imports this package."""
