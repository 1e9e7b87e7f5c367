"""Relational operators over factor graphs."""
