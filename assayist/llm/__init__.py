"""Operators on text and records for large training data. Nothing outside this subpackage imports it."""
