"""Discontinuous Galerkin layer: small dense one-dimensional numerics and the time steps built on them."""
