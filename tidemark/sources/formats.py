"""Reading and writing events as lines of JSON, binary rows and tables of other databases; telling stores apart."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codec import decode, encode
from ..model import COLUMNS, EVENT_SCHEMA, complete, malformed

BAD = "_bad"


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events of a file of JSON lines, and the lines (column ``_bad``) that hold none."""
    schema = T.StructType([*EVENT_SCHEMA.fields, T.StructField(BAD, T.StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)
    bad = F.col(BAD).isNotNull() | malformed()
    return complete(rows.where(~bad)), rows.where(bad).select(F.coalesce(F.col(BAD), F.to_json(F.struct(*COLUMNS))).alias(BAD))


def parse_lines(lines: Iterable[str]) -> tuple[list[tuple], list[str]]:
    """Events as tuples, and the lines that hold none."""
    rows, bad = [], []
    for line in lines:
        try:
            event = {"tags": [], "content": "", "sig": ""} | {k: v for k, v in json.loads(line).items() if v is not None}
            rows.append(tuple(event[c] for c in COLUMNS))
        except (ValueError, AttributeError, KeyError):
            bad.append(line)
    return rows, bad


def from_lines(spark: SparkSession, lines: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """Events of lines that the driver holds, such as standard input; and the lines that hold none."""
    rows, bad = parse_lines(lines)
    return spark.createDataFrame(rows, EVENT_SCHEMA), bad


def to_lines(events: DataFrame) -> Iterator[str]:
    """JSON lines, one partition at a time."""
    for row in events.select(F.to_json(F.struct(*COLUMNS)).alias("line")).toLocalIterator():
        yield row["line"]


def write_jsonl(events: DataFrame, path: str) -> None:
    events.select(*COLUMNS).write.json(path)


def to_binary(events: DataFrame) -> DataFrame:
    """Rows (id, data); data is null where an event doesn't fit."""
    return events.select("id", encode().alias("data"))


def from_binary(rows: DataFrame, column: str = "data") -> DataFrame:
    return rows.where(F.col(column).isNotNull()).select(decode(column).alias("e")).select("e.*")


class NoDriver(RuntimeError):
    """The class path has no JDBC driver for an address."""


#: Schemes of addresses, the JDBC scheme that stands for each, and the driver's class.
_JDBC = {
    "postgres": ("postgresql", "org.postgresql.Driver"), "postgresql": ("postgresql", "org.postgresql.Driver"), "mysql": ("mysql", "com.mysql.cj.jdbc.Driver"),
    "mariadb": ("mariadb", "org.mariadb.jdbc.Driver"), "sqlite": ("sqlite", "org.sqlite.JDBC"),
}


def jdbc_options(address: str) -> dict[str, str]:
    """Spark's options url, user, password and driver for an address, a JDBC URL or the path of an SQLite file.

    User and password move out of the URL, where JDBC doesn't take them; what follows ``?`` stays.
    """
    if address.startswith("jdbc:"):
        known = _JDBC.get(address.split(":")[1])
        return {"url": address} | ({"driver": known[1]} if known else {})
    if address.startswith("libsql://"):
        raise NoDriver("libsql has no JDBC driver; replicate the database to an SQLite file and open that")
    if "://" not in address:
        return {"url": f"jdbc:sqlite:{address}", "driver": _JDBC["sqlite"][1]}
    parts = urlsplit(address)
    if parts.scheme not in _JDBC:
        raise NoDriver(f"no JDBC driver is known for {parts.scheme}")
    scheme, driver = _JDBC[parts.scheme]
    if scheme == "sqlite":
        return {"url": f"jdbc:sqlite:{parts.netloc}{parts.path}", "driver": driver}
    host = (f"[{parts.hostname}]" if ":" in (parts.hostname or "") else parts.hostname or "localhost") + (f":{parts.port}" if parts.port else "")
    out = {"url": f"jdbc:{scheme}://{host}{parts.path}" + (f"?{parts.query}" if parts.query else ""), "driver": driver}
    return out | {k: unquote(v) for k, v in (("user", parts.username), ("password", parts.password)) if v is not None}


def _driver(spark: SparkSession, options: dict[str, str]) -> None:
    if name := options.get("driver"):
        jvm = spark.sparkContext._jvm
        try:
            jvm.java.lang.Class.forName(name, False, jvm.java.lang.Thread.currentThread().getContextClassLoader())
        except Exception as e:
            raise NoDriver(f"{name} is not on the class path (spark.jars or --packages)") from e


def read_jdbc(spark: SparkSession, address: str, table: str = "event", **options: str) -> DataFrame:
    """A database's event table, whose tags are JSON text. The database's driver must be on the class path."""
    known = jdbc_options(address)
    _driver(spark, known)
    rows = spark.read.format("jdbc").options(dbtable=table, **known, **options).load()
    return complete(rows.withColumn("tags", F.from_json(F.col("tags").cast("string"), "array<array<string>>")))


def write_jdbc(events: DataFrame, address: str, table: str = "event", mode: str = "append", **options: str) -> None:
    known = jdbc_options(address)
    _driver(events.sparkSession, known)
    events.select(*COLUMNS).withColumn("tags", F.to_json("tags")).write.format("jdbc").options(dbtable=table, **known, **options).mode(mode).save()


def detect(path: str) -> str:
    """The kind of store behind a path or address: jdbc, jsonl, snapshots, parquet, sqlite, null or unknown."""
    for prefix, kind in (("jdbc:", "jdbc"), ("postgres://", "jdbc"), ("postgresql://", "jdbc"), ("mysql://", "jdbc"), ("mariadb://", "jdbc"), ("sqlite://", "jdbc"), ("libsql://", "jdbc"), ("null:", "null")):
        if path.startswith(prefix):
            return kind
    if path.endswith((".jsonl", ".ndjson", ".json")):
        return "jsonl"
    if os.path.isdir(path):
        names = os.listdir(path)
        if "manifests" in names or not names:
            return "snapshots"
        return "parquet" if any(n.endswith(".parquet") for n in names) else "jsonl" if any(n.endswith(".json") for n in names) else "unknown"
    if os.path.isfile(path):
        with open(path, "rb") as f:
            head = f.read(16)
        return "sqlite" if head == b"SQLite format 3\0" else "parquet" if head[:4] == b"PAR1" else "jsonl" if head[:1] == b"{" else "unknown"
    return "snapshots"
