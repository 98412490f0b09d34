"""Columns over nested tags. Items are read with ``get``, so short tags give null instead of an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has(key: str, values: list[str], tags: str = "tags") -> Column:
    """Some tag has this key and one of these values."""
    return F.exists(tags, lambda t: (F.get(t, F.lit(0)) == key) & F.get(t, F.lit(1)).isin(values))


def first_value(key: str, tags: str = "tags") -> Column:
    """The first value of the first tag with this key, '' if there is none."""
    return F.coalesce(F.get(F.get(F.filter(tags, lambda t: F.get(t, F.lit(0)) == key), F.lit(0)), F.lit(1)), F.lit(""))


def tagvalues(tags: str = "tags") -> Column:
    """``key:value`` of every tag with a one-letter key and a value."""
    short = F.filter(tags, lambda t: (F.length(F.get(t, F.lit(0))) == 1) & (F.size(t) >= 2))
    return F.transform(short, lambda t: F.concat(F.get(t, F.lit(0)), F.lit(":"), F.get(t, F.lit(1))))


def address(value: Column) -> Column:
    """``kind:pubkey:d`` as a struct; null if the text isn't an address."""
    fits = value.rlike("^[0-9]{1,5}:[0-9a-f]{64}:[^:]*$")
    parts = F.split(value, ":")
    fits = fits & (F.get(parts, F.lit(0)).try_cast("int") <= 65535)
    return F.when(fits, F.struct(F.get(parts, F.lit(0)).cast("int").alias("kind"), F.get(parts, F.lit(1)).alias("pubkey"), F.get(parts, F.lit(2)).alias("d")))


def tag_rows(events: DataFrame, skip: Callable[[Column, Column], Column] | None = None, longer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The tag table's rows, once for each tag: in a table that isn't stored a filter of key and value reaches the events."""
    rows = events.select("id", "created_at", "kind", "pubkey", F.explode("tags").alias("t")).select("id", "created_at", "kind", "pubkey", F.get("t", F.lit(0)).alias("k"), F.get("t", F.lit(1)).alias("v"))
    size = F.length("v")
    fits = size.between(1, 100)
    if longer is not None:
        fits = fits | ((size > 100) & longer(F.col("k"), F.col("v")))
    rows = rows.where((F.length("k") == 1) & fits)
    if skip is not None:
        rows = rows.where(~skip(F.col("k"), F.col("v")))
    return rows


def tag_table(events: DataFrame, skip: Callable[[Column, Column], Column] | None = None, longer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """One row for each distinct (event, one-letter key, value of 1 to 100 characters), with the columns that narrow a search.

    Stored sorted by key and value, it lets a tag filter reach the scan, which nested arrays don't. ``skip`` drops values,
    ``longer`` admits values of over 100 characters. Each event is moved once, with the tags that can count, not once for each
    of them; its copies meet where it goes, and equal rows are dropped there.
    """
    event = ("id", "created_at", "kind", "pubkey")
    size = lambda t: F.length(F.get(t, F.lit(1)))
    some = F.filter("tags", lambda t: (F.length(F.get(t, F.lit(0))) == 1) & (size(t) >= 1 if longer is not None else size(t).between(1, 100)))
    short = F.array_distinct(F.transform(some, lambda t: F.slice(t, 1, 2)))
    # The array of one keeps Catalyst from working the tags out a second time for a filter on their number.
    moved = events.select(*event, F.explode_outer(F.array(short)).alias("tags")).where(F.size("tags") > 0).repartition(*event)
    return tag_rows(moved, skip, longer).distinct()
