"""streaming of the governance engine."""
