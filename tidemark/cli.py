"""``python -m tidemark -d STORE [query|save|delete|neg] [ARGUMENT]``: lines of JSON in and out.

Arguments come from the command line or, without one, from standard input, a line each. A line that can't be used is
reported on standard error and the others go on; the exit status is then 123. Without a command, each line is published
if it is an event and queried if it is a filter. Lines to save, publish or delete that follow each other are written in
batches of ``--batch``. ``decode`` prints events from their binary form in hexadecimal.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterable

from pyspark.sql import SparkSession

from .functions.codec import decode_text
from .model import EVENT_SCHEMA
from .operators import sync
from .plans.filters import Filter, parse_envelope
from .plans.query import Limits
from .sources.formats import NoDriver, detect, parse_lines, read_jdbc, to_lines
from .sources.store import Store, FrameStore, NullStore, ParquetStore, jsonl_store

FAILED = 123
COMMANDS = ("query", "save", "delete", "neg", "decode")


def open_store(spark: SparkSession, path: str, kind: str | None = None) -> Store:
    limits = Limits(1_000_000)
    match kind or detect(path):
        case "snapshots":
            return ParquetStore(spark, path, limits=limits, guards=None).open()
        case "parquet":
            return FrameStore(spark.read.parquet(path), limits=limits, guards=None)
        case "jsonl":
            return jsonl_store(spark, path, limits=limits, guards=None)
        case "jdbc" | "sqlite":
            try:
                return FrameStore(read_jdbc(spark, path), limits=limits, guards=None)
            except NoDriver as e:
                raise SystemExit(f"{path}: {e}") from e
        case "null":
            return NullStore(spark)
    raise SystemExit(f"can't tell what {path} is; give --type")


def _save(spark: SparkSession, store: Store, lines: list[str], publish: bool, fail) -> None:
    """One write for all lines that hold an event. Saving reports the lines whose event was there already."""
    held = []
    for line in lines:
        events, bad = parse_lines([line])
        if bad:
            fail(line, "not an event")
        else:
            held.append((line, events[0]))
    if not held:
        return
    if publish:
        return store.publish(spark.createDataFrame([e for _, e in held], EVENT_SCHEMA))
    known, fresh = store.known([e[0] for _, e in held]), []
    for line, event in held:
        if event[0] in known:
            fail(line, "DuplicateEvent")
        else:
            known.add(event[0])
            fresh.append(event)
    if fresh:
        store.save(spark.createDataFrame(fresh, EVENT_SCHEMA))


def run(spark: SparkSession, store: Store, command: str | None, lines: Iterable[str], out=None, err=None, batch: int = 1000) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    failed = False

    def fail(line: str, why: Exception | str) -> None:
        nonlocal failed
        failed = True
        print(f"{line.strip()[:200]}: {why}", file=err)

    def show(f: Filter) -> None:
        for event in to_lines(store.query(f)):
            print(event, file=out)

    def write(kind: str, held: list[str]) -> None:
        try:
            if kind == "delete":
                store.delete([json.loads(x) if x.lstrip().startswith('"') else x.strip() for x in held])
            else:
                _save(spark, store, held, kind == "publish", fail)
        except Exception as e:  # noqa: BLE001 - reported, and the other lines go on
            if len(held) > 1:  # find the ones that fail
                for line in held:
                    write(kind, [line])
            else:
                fail(held[0], type(e).__name__ + ": " + str(e)[:300])

    def read(line: str, f) -> None:
        try:
            for one in f(line):
                show(one)
        except Exception as e:  # noqa: BLE001 - reported, and the other lines go on
            fail(line, type(e).__name__ + ": " + str(e)[:300])

    held: list[str] = []
    kind = {"save": "save", "delete": "delete", None: "publish"}.get(command)
    for line in lines:
        if not line.strip():
            continue
        if command == "query":
            read(line, lambda x: [Filter.parse(x)])
            continue
        if command is None:
            try:
                what, value = parse_envelope(line)
            except Exception as e:  # noqa: BLE001 - reported, and the other lines go on
                fail(line, type(e).__name__ + ": " + str(e)[:300])
                continue
            if what == "filters":
                if held:  # a query sees what came before it
                    write(kind, held)
                    held = []
                read(line, lambda _, value=value: value)
                continue
            line = json.dumps(value)
        held.append(line)
        if len(held) == batch:
            write(kind, held)
            held = []
    if held:
        write(kind, held)
    return FAILED if failed else 0


def decode(lines: Iterable[str], out=None, err=None) -> int:
    """Prints the event of each line's binary form."""
    out, err, failed = out or sys.stdout, err or sys.stderr, False
    for line in lines:
        if line.strip():
            try:
                print(json.dumps(decode_text(line), ensure_ascii=False), file=out)
            except Exception as e:  # noqa: BLE001 - reported, and the other lines go on
                failed = True
                print(f"{line.strip()[:200]}: {type(e).__name__}", file=err)
    return FAILED if failed else 0


def reconcile(spark: SparkSession, store: Store, f: str, items: Iterable[str], out=None) -> int:
    """Prints what the other side, given as lines ``time id``, lacks (have) and what it has more (need)."""
    out = out or sys.stdout
    rows = [(int(a), b) for a, b in (line.split() for line in items if line.strip())]
    theirs = spark.createDataFrame(rows, "created_at bigint, id string")
    mine = store.query(Filter.parse(f), sync_session=True)
    for word, df in (("have", sync.have(mine, theirs)), ("need", sync.need(mine, theirs))):
        for row in df.orderBy("created_at", "id").toLocalIterator():
            print(word, row["id"], file=out)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("-d", "--store", default="null:")
    parser.add_argument("-t", "--type", choices=["snapshots", "parquet", "jsonl", "jdbc", "sqlite", "null"])
    parser.add_argument("--batch", type=int, default=1000, help="lines to write at a time")
    parser.add_argument("command", nargs="?", help="query, save, delete, neg, decode; or a line to publish or query")
    parser.add_argument("argument", nargs="?")
    a = parser.parse_args(argv)
    command, argument = (a.command, a.argument) if a.command in COMMANDS else (None, a.command)
    if command == "decode":
        return decode([argument] if argument else sys.stdin)
    spark = spark or SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = open_store(spark, a.store, a.type)
    try:
        if command == "neg":
            return reconcile(spark, store, argument or "{}", sys.stdin)
        return run(spark, store, command, [argument] if argument else sys.stdin, batch=a.batch)
    finally:
        store.close()
