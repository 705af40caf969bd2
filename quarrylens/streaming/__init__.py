"""Incremental maps over file streams."""
