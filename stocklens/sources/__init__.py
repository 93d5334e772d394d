"""Typed tables, readers, writers and the integrity check."""
