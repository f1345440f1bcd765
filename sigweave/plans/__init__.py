"""User-facing queries composed of operators."""
