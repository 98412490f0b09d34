"""Set reconciliation of two event sets by (time, id)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def items(events: DataFrame) -> DataFrame:
    return events.select("created_at", "id")


def have(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """What the other side lacks."""
    return items(mine).join(items(theirs), ["created_at", "id"], "left_anti")


def need(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """What the other side has and this one lacks."""
    return have(theirs, mine)
