"""Functions of the grid-relational engine."""
