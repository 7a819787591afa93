"""sources of the sanitizing engine."""
