"""Relational operators over corpora."""
