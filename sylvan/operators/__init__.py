"""Relational operators over the code tables."""
