"""streaming of the sanitizing engine."""
