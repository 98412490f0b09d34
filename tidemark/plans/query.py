"""Queries: match, order, limit. Sort and limit become one top-k per partition and a merge (TakeOrderedAndProject)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import COLUMNS
from .filters import Filter, Guards
from .predicates import LONG_LIST, Modes, compile_filter, matching


@dataclass(frozen=True)
class Limits:
    """How many rows a query gives: ``default`` where it names no limit, ``over`` where it asks for more than ``most``.
    ``sync_most`` holds in a synchronisation session."""

    most: int = 500
    default: int | None = None
    over: int | None = None
    sync_most: int = 1 << 24

    def rows(self, limit: int | None, sync_session: bool = False) -> int:
        most = max(self.most, self.sync_most) if sync_session else self.most
        if limit is None:
            return most if self.default is None or sync_session else self.default
        if limit > most:
            return most if self.over is None or sync_session else self.over
        return max(0, limit)


#: Limits and differing semantics of the kinds of store that the library can stand in for.
PROFILES: dict[str, tuple[Limits, Modes, str]] = {
    "canonical": (Limits(), Modes(), "id_asc"),
    "memory": (Limits(500, over=500), Modes(search="disabled"), "id_desc"),
    "kv": (Limits(1000, 250, 250), Modes(search="disabled"), "id_desc"),
    "kv_mapped": (Limits(1500, 375, 375), Modes(search="disabled"), "id_desc"),
    "sql": (Limits(100), Modes(), "id_asc"),
    "sql_embedded": (Limits(100), Modes("substring", "substring_nocase"), "id_asc"),
    "sql_json": (Limits(100), Modes("tuple", "substring_nocase"), "id_asc"),
    "documents": (Limits(100), Modes(search="regex"), "id_asc"),
    "wide_rows": (Limits(100), Modes("tuple_any", "substring"), "id_asc"),
    "graph": (Limits(100), Modes(search="substring_nocase"), "time"),
    "search_engine": (Limits(1000), Modes("token", "any_term", "prefix"), "id_asc"),
    "text_index": (Limits(150, 40), Modes(), "id_asc"),
}


def order(by: str = "id_asc") -> list[Column]:
    """Newest first; ties by id so that the result is total, unless only time is asked for."""
    newest = F.desc("created_at")
    return {"id_asc": [newest, F.asc("id")], "id_desc": [newest, F.desc("id")], "time": [newest]}[by]


def query(events: DataFrame, f: Filter, modes: Modes = Modes(), limits: Limits = Limits(), by: str = "id_asc", guards: Guards | None = Guards(), sync_session: bool = False, strict_hex: bool = False) -> DataFrame:
    """The newest matching events."""
    rows = limits.rows(f.check(guards, strict_hex).limit, sync_session)
    return matching(events, f, modes).select(*COLUMNS).orderBy(*order(by)).limit(rows)


def query_profile(events: DataFrame, f: Filter, profile: str, sync_session: bool = False) -> DataFrame:
    limits, modes, by = PROFILES[profile]
    return query(events, f, modes, limits, by, sync_session=sync_session)


def query_any(events: DataFrame, filters: list[Filter], modes: Modes = Modes(), limits: Limits = Limits(), by: str = "id_asc") -> DataFrame:
    """Several filters at once, each with its own limit; every event comes once.

    Filters without a limit of their own are one scan with their predicates or-ed; the others need their own top-k.
    """
    if all(f.limit is None and max(len(f.ids), len(f.authors)) <= LONG_LIST for f in filters):
        any_of = reduce(Column.__or__, (compile_filter(f.check(), modes) for f in filters), F.lit(False))
        return events.where(any_of).select(*COLUMNS).orderBy(*order(by)).limit(limits.rows(None))
    parts = [query(events, f, modes, limits, by) for f in filters]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["id"]).orderBy(*order(by))


def page_before(f: Filter, last_time: int) -> Filter:
    """The filter for what is older than a page's last event."""
    return Filter(**{**f.__dict__, "until": last_time - 1 if f.until is None else min(f.until, last_time - 1)})


def page_after(events: DataFrame, last_time: int, last_id: str, by: str = "id_asc") -> DataFrame:
    """The events that come after a page's last one in the order of ``query``: unlike ``page_before``, it keeps those that share its second."""
    same = {"id_asc": F.col("id") > last_id, "id_desc": F.col("id") < last_id, "time": F.lit(False)}[by]
    return events.where((F.col("created_at") < last_time) | ((F.col("created_at") == last_time) & same))
