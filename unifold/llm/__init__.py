"""Operators for large training-data work; nothing else in the library imports this package."""
