"""sources of the governance engine."""
