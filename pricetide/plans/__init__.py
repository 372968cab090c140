"""Composite catalog queries."""
