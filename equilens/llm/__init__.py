"""Operators for preparing language-model training data (no other module imports this package)."""
