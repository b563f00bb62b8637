"""Relational operators over the parsed tables."""
