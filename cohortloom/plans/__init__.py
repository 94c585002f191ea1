"""Operators bound to the star-schema tables, each with an independent SQL statement."""
