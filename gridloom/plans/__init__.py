"""Plans of the grid-relational engine."""
