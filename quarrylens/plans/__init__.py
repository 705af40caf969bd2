"""Derived corpora, query catalogue and its SQL."""
