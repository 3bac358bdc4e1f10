"""operators of the governance engine."""
