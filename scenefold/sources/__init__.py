"""Readers for the open and binary evidence formats."""
