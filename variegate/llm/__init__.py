"""Operators for preparing training text: thirteen numbered ones, their queries and SQL."""
