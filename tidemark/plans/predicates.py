"""Filters as columns. The defaults are the canonical semantics; the other modes are those that single stores differ by."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags as tg
from ..functions.text import tokenise, tokens
from .filters import Filter

#: Lists longer than this become a semi-join, which is broadcast up to MOST_BROADCAST values (of about 80 bytes each).
LONG_LIST, MOST_BROADCAST = 1000, 250_000


@dataclass(frozen=True)
class Modes:
    """tag_match: exact, substring, tuple, tuple_any or token; search: substring, substring_nocase, all_terms, any_term,
    regex or disabled; id_match: exact or prefix; max_text: how much of the content search reads, None for all."""

    tag_match: str = "exact"
    search: str = "all_terms"
    id_match: str = "exact"
    max_text: int | None = None


def _tag_predicates(f: Filter, mode: str) -> list[Column]:
    text = F.to_json("tags")
    quoted = lambda k, vs: json.dumps([k, *vs], separators=(",", ":"), ensure_ascii=False)
    if mode == "exact":
        return [tg.has(k, list(v)) for k, v in f.tags.items()]
    if mode == "substring":  # the key plays no part
        return [reduce(Column.__or__, (F.contains(text, F.lit(x)) for x in v)) for v in f.tags.values()]
    if mode == "tuple":  # some tag is the key with exactly these values
        return [F.array_contains("tags", F.array(F.lit(k), *map(F.lit, v))) for k, v in f.tags.items()]
    if mode == "tuple_any":
        return [reduce(Column.__or__, (F.contains(text, F.lit(quoted(k, v))) for k, v in f.tags.items()))]
    if mode == "token":  # any item of any tag, the key included
        return [reduce(Column.__or__, (F.arrays_overlap(F.flatten("tags"), F.array(*map(F.lit, v), F.lit(k))) for k, v in f.tags.items()))]
    raise ValueError(f"unknown tag_match {mode}")


def _search(text: str, modes: Modes) -> Column:
    content = F.col("content") if modes.max_text is None else F.left(F.col("content"), F.lit(modes.max_text))
    terms = tokenise(text)
    match modes.search:
        case "substring":
            return F.contains(content, F.lit(text))
        case "substring_nocase":
            return F.contains(F.lower(content), F.lower(F.lit(text)))
        case "all_terms":
            own = tokens(content)
            return reduce(Column.__and__, (F.array_contains(own, t) for t in terms), F.lit(True))
        case "any_term":
            return (F.col("kind") != 4) & F.arrays_overlap(tokens(content), F.array(*map(F.lit, terms)).cast("array<string>"))
        case "regex":
            return content.rlike(text)
        case "disabled":
            return F.lit(False)
    raise ValueError(f"unknown search mode {modes.search}")


def _one_of(column: str, values: tuple, mode: str) -> Column:
    if mode == "exact" or column == "kind":
        return F.col(column).isin(*values)
    whole = [v for v in values if len(v) >= 64]
    starts = [F.col(column).startswith(v) for v in values if len(v) < 64]
    return reduce(Column.__or__, [*starts, *([F.col(column).isin(*whole)] if whole else [])])


def compile_filter(f: Filter, modes: Modes = Modes()) -> Column:
    """The predicate; true where nothing is asked for."""
    parts = [_one_of(c, v, modes.id_match) for c, v in (("id", f.ids), ("pubkey", f.authors), ("kind", f.kinds)) if v and len(v) <= LONG_LIST]
    if f.since is not None:
        parts.append(F.col("created_at") >= f.since)
    if f.until is not None:
        parts.append(F.col("created_at") <= f.until)
    if f.tags:
        parts += _tag_predicates(f, modes.tag_match)
    if f.search:
        parts.append(_search(f.search, modes))
    return reduce(Column.__and__, parts) if parts else F.lit(True)


def matching(events: DataFrame, f: Filter, modes: Modes = Modes()) -> DataFrame:
    """The events that match, in no order."""
    out = events.where(compile_filter(f, modes))
    for column, values in (("id", f.ids), ("pubkey", f.authors)):
        if len(values) > LONG_LIST:
            wanted = events.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], f"{column} string")
            out = out.join(F.broadcast(wanted) if len(values) <= MOST_BROADCAST else wanted, column, "left_semi")
    return out
