"""Operators that turn a raw corpus into training data."""
