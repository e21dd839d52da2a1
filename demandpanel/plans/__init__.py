"""Composite studies built from the operators."""
