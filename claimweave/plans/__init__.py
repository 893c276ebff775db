"""Queries by name; importing a module registers its queries."""
