"""The filter language: parsing, and checks made before anything is planned."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field


class FilterError(ValueError):
    """A filter that can't be run."""


class TooManyValues(FilterError):
    """A list in a filter is longer than the store allows."""


class EmptyTagSet(FilterError):
    """A tag key without values."""


class BadHex(FilterError):
    """An id or author that isn't hexadecimal."""


@dataclass(frozen=True)
class Guards:
    """Most values of each list."""

    ids: int = 500
    authors: int = 500
    kinds: int = 10
    tag_values: int = 100


@dataclass(frozen=True)
class Filter:
    """All predicates that are present must hold. Empty lists of ids, authors and kinds count as absent."""

    ids: tuple[str, ...] = ()
    authors: tuple[str, ...] = ()
    kinds: tuple[int, ...] = ()
    tags: dict[str, tuple[str, ...]] = field(default_factory=dict)
    since: int | None = None
    until: int | None = None
    search: str = ""
    limit: int | None = None

    @classmethod
    def parse(cls, source: str | dict) -> Filter:
        """From filter JSON; ``#x`` members are tag keys."""
        d = json.loads(source) if isinstance(source, str) else source
        if not isinstance(d, dict):
            raise FilterError("a filter is a JSON object")
        try:
            return cls(
                tuple(map(str, d.get("ids") or ())), tuple(map(str, d.get("authors") or ())), tuple(map(int, d.get("kinds") or ())),
                {k.removeprefix("#"): tuple(map(str, v)) for k, v in d.items() if k.startswith("#")},
                None if d.get("since") is None else int(d["since"]), None if d.get("until") is None else int(d["until"]),
                str(d.get("search") or ""), None if d.get("limit") is None else int(d["limit"]),
            )
        except (TypeError, AttributeError) as e:
            raise FilterError(f"bad filter: {e}") from e

    def to_json(self) -> str:
        d = {k: list(v) for k, v in (("ids", self.ids), ("authors", self.authors), ("kinds", self.kinds)) if v}
        d |= {f"#{k}": list(v) for k, v in self.tags.items()}
        d |= {k: v for k, v in (("since", self.since), ("until", self.until), ("limit", self.limit)) if v is not None}
        return json.dumps(d | ({"search": self.search} if self.search else {}))

    def check(self, guards: Guards | None = Guards(), strict_hex: bool = False) -> Filter:
        """Raises on what no plan should be made for; returns the filter."""
        for key, values in self.tags.items():
            if not values:
                raise EmptyTagSet(key)
        if guards is not None:
            counts = (("ids", len(self.ids), guards.ids), ("authors", len(self.authors), guards.authors), ("kinds", len(self.kinds), guards.kinds))
            for name, n, most in (*counts, ("tag values", sum(map(len, self.tags.values())), guards.tag_values)):
                if n > most:
                    raise TooManyValues(f"{n} {name}; at most {most}")
        if strict_hex:
            for value in (*self.ids, *self.authors, *self.tags.get("p", ()), *self.tags.get("e", ())):
                if not re.fullmatch("[0-9a-f]{64}", value):
                    raise BadHex(value)
        return self


def parse_envelope(line: str) -> tuple[str, object]:
    """("event", dict), ("filters", [Filter, ...]) or an error, by trying: EVENT envelope, event, REQ envelope, filter."""
    value = json.loads(line)
    if isinstance(value, list) and len(value) > 1 and value[0] == "EVENT" and isinstance(value[-1], dict):
        return "event", value[-1]
    if isinstance(value, dict) and {"id", "pubkey", "kind", "created_at"} <= value.keys():
        return "event", value
    if isinstance(value, list) and len(value) > 2 and value[0] == "REQ":
        return "filters", [Filter.parse(f) for f in value[2:]]
    if isinstance(value, dict) and value:
        return "filters", [Filter.parse(value)]
    raise FilterError("neither an event nor a filter")
