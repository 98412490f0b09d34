"""The compact binary form of events.

Layout: id 32, pubkey 32 and signature 64 bytes, time as 4 and kind as 2 bytes, content with a 2-byte length, a 2-byte
count of tags, then each tag as a 1-byte count of items, each item as a 2-byte length, its bytes and a zero byte. Numbers
are big-endian. Encoding is built-in expressions; decoding walks the tags in Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import EVENT_SCHEMA, MAX_CONTENT, MAX_ITEM, MAX_ITEMS, MAX_KIND, MAX_TAGS, MAX_TIME


def eligible() -> Column:
    """Whether an event fits the binary form."""
    return (
        (F.octet_length("content") <= MAX_CONTENT)
        & F.col("kind").between(0, MAX_KIND)
        & F.col("created_at").between(0, MAX_TIME)
        & (F.size("tags") <= MAX_TAGS)
        & F.forall("tags", lambda t: (F.size(t) <= MAX_ITEMS) & F.forall(t, lambda x: F.octet_length(x) <= MAX_ITEM))
    )


def _be(value: Column, size: int) -> Column:
    return F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")


def _bytes(text: Column) -> Column:
    return F.hex(F.encode(text, "UTF-8"))


def encode() -> Column:
    """The event's bytes; null if it doesn't fit. A missing signature is 64 zero bytes."""
    item = lambda x: F.concat(_be(F.octet_length(x), 2), _bytes(x), F.lit("00"))
    tag = lambda t: F.concat(_be(F.size(t), 1), F.array_join(F.transform(t, item), ""))
    text = F.concat(
        F.col("id"), F.col("pubkey"), F.rpad("sig", 128, "0"), _be(F.col("created_at"), 4), _be(F.col("kind"), 2), _be(F.octet_length("content"), 2), _bytes(F.col("content")),
        _be(F.size("tags"), 2), F.array_join(F.transform("tags", tag), ""),
    )
    return F.when(eligible(), F.unhex(text))


def unpack(data: bytes) -> dict:
    """One event from its bytes."""
    time, kind, size = struct.unpack_from(">IHH", data, 128)
    at = 136 + size
    content = data[136:at].decode("utf-8", "replace")
    (count,) = struct.unpack_from(">H", data, at)
    at, tags = at + 2, []
    for _ in range(count):
        items, at = [], at + 1
        for _ in range(data[at - 1]):
            (size,) = struct.unpack_from(">H", data, at)
            items.append(data[at + 2 : at + 2 + size].decode("utf-8", "replace"))
            at += size + 3
        tags.append(items)
    return {"id": data[:32].hex(), "pubkey": data[32:64].hex(), "created_at": time, "kind": kind, "tags": tags, "content": content, "sig": data[64:128].hex()}


@F.pandas_udf(EVENT_SCHEMA)
def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """A struct of event columns."""
    for batch in batches:
        yield pd.DataFrame([unpack(x) for x in batch], columns=EVENT_SCHEMA.names)


def decode_text(text: str) -> dict:
    """One event from a hexadecimal text, with or without 0x, or from raw bytes read as Latin-1."""
    bare = text.strip().removeprefix("0x")
    try:
        return unpack(bytes.fromhex(bare))
    except ValueError:
        return unpack(text.encode("latin-1"))
