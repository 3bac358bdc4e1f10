"""functions of the governance engine."""
