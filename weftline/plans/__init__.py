"""Registries of queries and helpers for plans."""
