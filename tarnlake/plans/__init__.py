"""Configured workflows over the operators."""
