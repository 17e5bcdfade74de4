"""Operators for building training text; nothing else in the package imports this."""
