"""Operators for preparing training text; nothing outside this package imports it."""
