"""operators of the sanitizing engine."""
