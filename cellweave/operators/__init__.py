"""Operators: each takes a DataFrame and gives a DataFrame, lazily."""
