"""Relational operators over ordered key-value tables."""
