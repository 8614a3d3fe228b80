"""Relational operators over trees, edits and text."""
