"""Expressions of the dialect as columns."""
