"""Queries through the exploded tag table, whose key and value reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.filters import Filter

MAX_VALUE = 100


def usable(f: Filter) -> list[str]:
    """The tag keys of a filter that the tag table has: of one letter, with values of 1 to 100 characters."""
    return sorted(k for k, v in f.tags.items() if len(k) == 1 and all(1 <= len(x) <= MAX_VALUE for x in v))


def hits(tags: DataFrame, f: Filter, key: str) -> DataFrame:
    """The tag table's rows for one key of the filter, narrowed by what else it says of them."""
    out = tags.where((F.col("k") == key) & F.col("v").isin(*f.tags[key]))
    if f.kinds:
        out = out.where(F.col("kind").isin(*f.kinds))
    if f.since is not None:
        out = out.where(F.col("created_at") >= f.since)
    if f.until is not None:
        out = out.where(F.col("created_at") <= f.until)
    return out


def narrowest(tags: DataFrame, f: Filter) -> str | None:
    """The key with the fewest hits, which are counted where there is a choice; None if the table can't help.

    In a table sorted by key and value a count reads only the row groups that hold them.
    """
    keys = usable(f)
    if len(keys) < 2:
        return keys[0] if keys else None
    parts = [hits(tags, f, k).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("k"), "n") for k in keys]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return min(union.collect(), key=lambda r: (r["n"], r["k"]))["k"]  # a row for each key of the filter


def through_tags(events: DataFrame, tags: DataFrame, f: Filter, key: str | None = None) -> DataFrame:
    """Events that the tag table finds for one key (the filter's narrowest); all of them where it can't help."""
    key = key or narrowest(tags, f)
    return events if key is None else events.join(hits(tags, f, key).select("id"), "id", "left_semi")
