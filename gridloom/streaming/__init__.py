"""Streaming of the grid-relational engine."""
