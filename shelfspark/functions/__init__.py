"""Catalog functions."""
