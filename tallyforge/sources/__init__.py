"""Sources of the aggregate engine."""
