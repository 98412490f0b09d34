"""Filters and their translation to columns, order and limit."""
