"""Catalog sources."""
