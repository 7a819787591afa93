"""functions of the sanitizing engine."""
