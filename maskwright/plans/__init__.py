"""plans of the sanitizing engine."""
