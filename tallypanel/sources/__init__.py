"""Readers for landed feeds and lookup files."""
