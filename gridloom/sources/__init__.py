"""Sources of the grid-relational engine."""
