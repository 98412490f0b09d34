"""Whole-table operators: counts, sketches, search, writes, reconciliation and the tag table."""
