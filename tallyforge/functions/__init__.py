"""Functions of the aggregate engine."""
