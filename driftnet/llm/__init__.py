"""Operators for large text corpora; nothing outside imports this package."""
