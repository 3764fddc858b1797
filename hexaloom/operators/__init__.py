"""Relational operators on samples and neurons."""
