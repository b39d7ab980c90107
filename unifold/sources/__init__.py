"""Readers that return raw records."""
