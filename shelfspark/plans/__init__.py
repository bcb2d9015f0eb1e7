"""Registered queries over the given tables, one module per area, each with its SQL."""
