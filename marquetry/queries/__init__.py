"""Queries by name, each with its SQL."""
