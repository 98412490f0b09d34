"""The event table's schema, the classes of kinds, and bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ("id", "pubkey", "created_at", "kind", "tags", "content", "sig")

EVENT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("pubkey", T.StringType(), False),
    T.StructField("created_at", T.LongType(), False),
    T.StructField("kind", T.IntegerType(), False),
    T.StructField("tags", T.ArrayType(T.ArrayType(T.StringType())), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("sig", T.StringType(), False),
])

MAX_TIME, MAX_KIND = (1 << 32) - 1, (1 << 16) - 1
#: Longest content, tag item, tag list and tag that the binary form can hold.
MAX_CONTENT, MAX_ITEM, MAX_TAGS, MAX_ITEMS = 65535, 65535, 65535, 255

REGULAR, REPLACEABLE, EPHEMERAL, ADDRESSABLE = "regular", "replaceable", "ephemeral", "addressable"


def kind_class(kind: Column | str = "kind") -> Column:
    """Which write rule an event falls under; kinds from 40000 on are regular."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    return (
        F.when(kind.isin(0, 3) | kind.between(10000, 19999), REPLACEABLE)
        .when(kind.between(20000, 29999), EPHEMERAL)
        .when(kind.between(30000, 39999), ADDRESSABLE)
        .otherwise(REGULAR)
    )


def within_bounds() -> Column:
    return F.col("created_at").between(0, MAX_TIME) & F.col("kind").between(0, MAX_KIND)


def complete(df: DataFrame) -> DataFrame:
    """The event columns in order and type; absent tags, content and signature become empty."""
    empty = {"tags": F.array().cast("array<array<string>>"), "content": F.lit(""), "sig": F.lit("")}
    have = set(df.columns)
    out = []
    for f in EVENT_SCHEMA:
        c = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        out.append((F.coalesce(c, empty[f.name]) if f.name in empty else c).alias(f.name))
    return df.select(*out)


def malformed() -> Column:
    """Rows that lack what no default can stand for."""
    return F.col("id").isNull() | F.col("pubkey").isNull() | F.col("created_at").isNull() | F.col("kind").isNull()
