"""Operators of the grid-relational engine."""
