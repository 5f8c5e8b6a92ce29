"""Relational operators over spatial evidence tables."""
