"""Formatting and number checks."""
