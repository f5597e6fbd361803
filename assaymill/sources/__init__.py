"""Readers of the inputs, and parsers of line-oriented text."""
