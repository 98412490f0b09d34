"""Stores and file formats."""
