"""Plans of the aggregate engine."""
