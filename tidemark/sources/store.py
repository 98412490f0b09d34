"""Event stores: one interface over tables in memory, versioned Parquet, JSON lines and nothing at all.

A Parquet store is a list of manifests. Each names the directories that make up one version: segments of regular events,
which saving only adds to; replaceable and addressable events in buckets by their key, of which publishing rewrites those
that the batch touches; ids that were deleted, each list with the version that deleted them, so that it leaves alone what
was saved later; and sketches of authors. Readers use the newest manifest and never see a half-written version. Two
writers of the same version can't both succeed on a file system whose create-without-overwrite is atomic, such as HDFS or
a local one; on an object store without conditional writes, let one process write.

A write costs in proportion to its batch: the batch's ids meet the store's by a broadcast if they are few, which is
counted, and the store's own rows are neither shuffled nor rewritten, but for touched buckets.
"""

from __future__ import annotations

import copy
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import tag_table
from ..model import EVENT_SCHEMA, REGULAR, complete, kind_class
from ..operators import counts, tagtable, writes
from ..plans.filters import Filter, Guards
from ..plans.predicates import Modes
from ..plans.query import Limits, query
from .formats import read_jsonl

#: Buckets of replaceable and addressable events, and the most ids of a batch that are broadcast (of about 80 bytes each).
BUCKETS, SMALL_BATCH = 64, 250_000


class DuplicateEvent(ValueError):
    """A saved event was there already."""


class Conflict(RuntimeError):
    """Another writer made the version first."""


class Store:
    """Queries over ``events()``; subclasses say where events are and what writing does."""

    def __init__(self, spark: SparkSession, modes: Modes = Modes(), limits: Limits = Limits(), order: str = "id_asc", guards: Guards | None = Guards(), strict_hex: bool = False) -> None:
        self.spark, self.modes, self.limits, self.order, self.guards, self.strict_hex = spark, modes, limits, order, guards, strict_hex

    def open(self) -> Store:
        return self

    def close(self) -> None:
        pass

    def events(self) -> DataFrame:
        raise NotImplementedError

    def query(self, f: Filter, sync_session: bool = False) -> DataFrame:
        return query(self.events(), f, self.modes, self.limits, self.order, self.guards, sync_session, self.strict_hex)

    def query_list(self, f: Filter) -> list[dict]:
        """The result as dicts; its size is bounded by the limit."""
        return [r.asDict() for r in self.query(f).collect()]

    def count(self, f: Filter) -> int:
        return counts.count(self.events(), f, self.modes).first()["n"]

    def save(self, batch: DataFrame, strict: bool = False) -> int:
        """How many events were new. With ``strict``, an event that was there is an error."""
        raise NotImplementedError

    def known(self, ids: list[str]) -> set[str]:
        """Which of the ids are there."""
        batch = self._ids(list(dict.fromkeys(ids)))
        return {r["id"] for r in writes.known_ids(self.events(), batch, len(ids) <= SMALL_BATCH).collect()}

    def replace(self, batch: DataFrame) -> None:
        self.publish(batch)

    def publish(self, batch: DataFrame) -> None:
        raise NotImplementedError

    def delete(self, ids: list[str] | DataFrame) -> None:
        raise NotImplementedError

    def _ids(self, ids: list[str] | DataFrame) -> DataFrame:
        return ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id string")


class NullStore(Store):
    """Keeps nothing."""

    def events(self) -> DataFrame:
        return self.spark.createDataFrame([], EVENT_SCHEMA)

    def save(self, batch: DataFrame, strict: bool = False) -> int:
        return 0

    def publish(self, batch: DataFrame) -> None:
        pass

    def delete(self, ids: list[str] | DataFrame) -> None:
        pass


class MemoryStore(Store):
    """Events that the driver holds, for tests and small sets."""

    def __init__(self, spark: SparkSession, rows: list | None = None, **options) -> None:
        super().__init__(spark, **options)
        self._rows = list(rows or [])

    def events(self) -> DataFrame:
        return self.spark.createDataFrame(self._rows, EVENT_SCHEMA)

    def save(self, batch: DataFrame, strict: bool = False) -> int:
        new = writes.save(self.events(), batch).inserted.collect()
        if strict and len(new) < batch.count():
            raise DuplicateEvent
        self._rows += [tuple(r) for r in new]
        return len(new)

    def publish(self, batch: DataFrame) -> None:
        self._rows = [tuple(r) for r in writes.publish(self.events(), batch).collect()]

    def delete(self, ids: list[str] | DataFrame) -> None:
        self._rows = [tuple(r) for r in writes.delete(self.events(), self._ids(ids)).collect()]


class FrameStore(Store):
    """Any DataFrame of events, to be read only."""

    def __init__(self, events: DataFrame, **options) -> None:
        super().__init__(events.sparkSession, **options)
        self._events = events

    def events(self) -> DataFrame:
        return self._events


class JsonlStore(Store):
    """A folder (or, to be read only, a file) of JSON lines; lines without an event are left out.

    Saving adds files; deleting and publishing rewrite the folder: the new one is complete before it takes the old one's place.
    """

    def __init__(self, spark: SparkSession, path: str, **options) -> None:
        super().__init__(spark, **options)
        self.path = path.rstrip("/")
        self._Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def events(self) -> DataFrame:
        if not self._fs.exists(self._Path(self.path)):
            return self.spark.createDataFrame([], EVENT_SCHEMA)
        return read_jsonl(self.spark, self.path)[0]

    def _folder(self) -> None:
        if self._fs.exists(self._Path(self.path)) and not self._fs.getFileStatus(self._Path(self.path)).isDirectory():
            raise NotImplementedError(f"{self.path} is a single file, which can only be read")

    def save(self, batch: DataFrame, strict: bool = False) -> int:
        self._folder()
        staged = f"{self.path}.{uuid.uuid4().hex}"
        once = writes.validated(batch)[0].dropDuplicates(["id"])
        once.write.parquet(staged)
        try:
            once = self.spark.read.schema(EVENT_SCHEMA).parquet(staged)
            size = once.count()
            new = writes.save(self.events(), once, small=size <= SMALL_BATCH).inserted.cache()
            n = new.count()
            if strict and n < size:
                raise DuplicateEvent
            new.write.mode("append").json(self.path)
            new.unpersist()
        finally:
            self._fs.delete(self._Path(staged), True)
        return n

    def _rewrite(self, events: DataFrame) -> None:
        self._folder()
        fresh, old = (f"{self.path}.{uuid.uuid4().hex}" for _ in range(2))
        events.select(*EVENT_SCHEMA.names).write.json(fresh)
        there = self._fs.exists(self._Path(self.path))
        if there:
            self._fs.rename(self._Path(self.path), self._Path(old))
        self._fs.rename(self._Path(fresh), self._Path(self.path))
        if there:
            self._fs.delete(self._Path(old), True)

    def publish(self, batch: DataFrame) -> None:
        self._rewrite(writes.publish(self.events(), batch))

    def delete(self, ids: list[str] | DataFrame) -> None:
        self._rewrite(writes.delete(self.events(), self._ids(ids)))


def jsonl_store(spark: SparkSession, path: str, **options) -> JsonlStore:
    return JsonlStore(spark, path, **options)


class ParquetStore(Store):
    """Versioned Parquet below ``path``, on any file system that Spark writes to.

    ``sketch`` maps kinds to the tag whose values get a sketch of the authors that name them, kept up with every save and
    publish; events for which ``sketch_only`` holds are counted in their sketches and not stored.
    """

    def __init__(self, spark: SparkSession, path: str, sketch: dict[int, str] | None = None, sketch_only: Column | None = None, **options) -> None:
        super().__init__(spark, **options)
        self.path, self.sketch, self.sketch_only = path.rstrip("/"), sketch, sketch_only
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- versions

    def _manifest(self) -> dict:
        folder = self._Path(f"{self.path}/manifests")
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []
        if not names:
            return {"version": 0, "regular": [], "moved": {}, "deleted": [], "tags": None, "sketches": []}
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(f"{self.path}/manifests/{names[-1]}").collect()))

    def _commit(self, manifest: dict) -> None:
        version = manifest["version"] + 1
        path = self._Path(f"{self.path}/manifests/{version:012d}.json")
        try:
            out = self._fs.create(path, False)
        except Exception as e:
            raise Conflict(f"version {version} exists") from e
        out.write(bytearray(json.dumps(manifest | {"version": version}).encode()))
        out.close()

    def _write(self, df: DataFrame, kind: str, m: dict, sort: list[str] | None = None, by: str | None = None) -> str:
        """The name carries the version that the table will belong to."""
        name = f"{kind}-{m['version'] + 1:012d}-{uuid.uuid4().hex}"
        if sort:
            df = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
        writer = df.write.option("parquet.bloom.filter.enabled#id", "true")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{name}")
        return name

    def _read(self, names: list[str], schema=EVENT_SCHEMA) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def _remove(self, name: str) -> None:
        self._fs.delete(self._Path(f"{self.path}/{name}"), True)

    # -- the interface

    def open(self) -> ParquetStore:
        if self._manifest()["version"] == 0:
            self._commit(self._manifest())
        return self

    def _live(self, m: dict, names: list[str] | None = None) -> DataFrame:
        """The events of these tables (all by default) without those that a later version deleted."""
        rows = self._read([*m["regular"], *m["moved"].values()] if names is None else names)
        if not m["deleted"]:
            return complete(rows)
        version = lambda c: F.regexp_extract(c, "/[a-z]+-([0-9]{12})-[0-9a-f]{32}/", 1).cast("bigint")
        rows = rows.withColumn("__version", version(F.col("_metadata.file_path"))) if rows.inputFiles() else rows.withColumn("__version", F.lit(0))
        gone = self._read(m["deleted"], "id string")
        few = gone.count() <= SMALL_BATCH
        gone = gone.withColumn("__since", version(F.col("_metadata.file_path"))).groupBy("id").agg(F.max("__since").alias("__since")).withColumnRenamed("id", "__gone")
        return complete(rows.join(F.broadcast(gone) if few else gone, (F.col("id") == F.col("__gone")) & (F.col("__version") < F.col("__since")), "left_anti"))

    def events(self) -> DataFrame:
        return self._live(self._manifest())

    def query(self, f: Filter, sync_session: bool = False) -> DataFrame:
        m = self._manifest()
        rows = self._live(m)
        if m["tags"] and f.tags and self.modes.tag_match == "exact":
            rows = tagtable.through_tags(rows, self._read([m["tags"]], "id string, created_at bigint, kind int, pubkey string, k string, v string"), f)
        return query(rows, f, self.modes, self.limits, self.order, self.guards, sync_session, self.strict_hex)

    def _staged(self, batch: DataFrame, m: dict) -> tuple[str, int]:
        """The batch's events, each once, written so that they are counted and read at no cost; and their number."""
        name = self._write(batch.dropDuplicates(["id"]), "staged", m)
        return name, self._read([name]).count()

    def _sketched(self, new: DataFrame, m: dict) -> dict:
        if not self.sketch:
            return {}
        return {"sketches": [*m["sketches"], self._write(counts.author_sketches(new, self.sketch), "sketches", m)]}

    def _kept(self, new: DataFrame) -> DataFrame:
        return new if self.sketch_only is None else new.where(~F.coalesce(self.sketch_only, F.lit(False)))

    def sketches(self) -> DataFrame:
        """The sketches of all versions, merged: kind, ref, n, sketch. Deletion doesn't take events out of them."""
        return counts.merge_sketches(self._read(self._manifest()["sketches"], "kind int, ref string, n bigint, sketch binary"))

    def save(self, batch: DataFrame, strict: bool = False) -> int:
        m = self._manifest()
        staged, size = self._staged(writes.validated(batch)[0], m)
        try:
            saved = writes.save(self._live(m), self._read([staged]), small=size <= SMALL_BATCH)
            name = self._write(self._kept(saved.inserted), "regular", m, ["created_at", "id"])
            if self.sketch_only is None:
                n = self._read([name]).count()
            else:
                n = saved.inserted.count()
            if strict and n < size:
                raise DuplicateEvent
            self._commit(m | {"regular": [*m["regular"], name], "tags": None} | self._sketched(saved.inserted, m))
        finally:
            self._remove(staged)
        return n

    def publish(self, batch: DataFrame) -> None:
        m = self._manifest()
        staged, size = self._staged(writes.validated(batch)[0], m)
        try:
            good = self._read([staged])
            new = writes.save(self._live(m, m["regular"]), good.where(kind_class() == REGULAR), small=size <= SMALL_BATCH).inserted
            moving = good.where(kind_class() != REGULAR)
            touched = [str(r["bucket"]) for r in _bucketed(moving).select("bucket").distinct().collect()]  # at most BUCKETS
            change = {"regular": [*m["regular"], self._write(self._kept(new), "regular", m, ["created_at", "id"])], "tags": None}
            if touched:
                moved = writes.publish(self._live(m, [m["moved"][b] for b in touched if b in m["moved"]]), self._kept(moving))
                change["moved"] = m["moved"] | self._write_moved(moved, m, touched)
            self._commit(m | change | self._sketched(new.unionByName(moving.where(kind_class() != writes.EPHEMERAL)), m))
        finally:
            self._remove(staged)

    def _write_moved(self, moved: DataFrame, m: dict, buckets: list[str]) -> dict[str, str]:
        name = self._write(_bucketed(moved).repartition("bucket").sortWithinPartitions("bucket", "created_at", "id"), "moved", m, by="bucket")
        made = {b for b in buckets if self._fs.exists(self._Path(f"{self.path}/{name}/bucket={b}"))}
        return {b: f"{name}/bucket={b}" for b in buckets if b in made}

    def delete(self, ids: list[str] | DataFrame) -> None:
        m = self._manifest()
        self._commit(m | {"deleted": [*m["deleted"], self._write(self._ids(ids).select("id").distinct(), "deleted", m)]})

    # -- maintenance

    def _rewritten(self, rows: DataFrame, m: dict) -> dict:
        regular = self._write(rows.where(kind_class() == REGULAR), "regular", m, ["created_at", "id"])
        return m | {"regular": [regular], "moved": self._write_moved(rows.where(kind_class() != REGULAR), m, [str(b) for b in range(BUCKETS)]), "deleted": []}

    def compact(self) -> None:
        """Rewrites the live events in order of time, without what was deleted, and the sketches as one table."""
        m = self._manifest()
        change = {"sketches": [self._write(self.sketches(), "sketches", m)]} if m["sketches"] else {}
        self._commit(self._rewritten(self._live(m), m) | change)

    def vacuum(self) -> int:
        """Removes tables and manifests that the newest version doesn't name, and says how many; earlier readers lose them."""
        m = self._manifest()
        used = {n.split("/")[0] for n in [*m["regular"], *m["moved"].values(), *m["deleted"], *m["sketches"], *([m["tags"]] if m["tags"] else [])]}
        dead = [n for n in (s.getPath().getName() for s in self._fs.listStatus(self._Path(self.path))) if n not in used and n != "manifests"]
        old = [n for n in (s.getPath().getName() for s in self._fs.listStatus(self._Path(f"{self.path}/manifests"))) if n < f"{m['version']:012d}.json"]
        for name in [*dead, *(f"manifests/{n}" for n in old)]:
            self._remove(name)
        return len(dead)

    def rebuild_tags(self, skip=None, longer=None) -> None:
        """Derives the tag table anew, sorted so that a key and value are found by row-group statistics."""
        m = self._manifest()
        self._commit(m | {"tags": self._write(tag_table(self._live(m), skip, longer), "tags", m, ["k", "v", "created_at"])})

    def keep_recent(self, keep: int = 100) -> None:
        """Drops what is older than each author's event number ``keep`` + 1."""
        m = self._manifest()
        self._commit(self._rewritten(writes.retain(self._live(m), keep), m) | {"tags": None})


def _bucketed(events: DataFrame) -> DataFrame:
    return events.withColumn("bucket", F.pmod(F.xxhash64(*writes.replacement_key()), F.lit(BUCKETS)))


class _Wrapped:
    """A store with some methods of its own; all else is the inner store's."""

    def __init__(self, inner: Store) -> None:
        self._inner = inner

    def __getattr__(self, name: str):
        return getattr(self._inner, name)


class _Skipping(_Wrapped):
    def __init__(self, inner: Store, skip: Column) -> None:
        super().__init__(inner)
        self._skip = skip

    def _rest(self, batch: DataFrame) -> DataFrame:
        return batch.where(~F.coalesce(self._skip, F.lit(False)))

    def save(self, batch: DataFrame, strict: bool = False) -> int:
        return self._inner.save(self._rest(batch), strict)

    def publish(self, batch: DataFrame) -> None:
        self._inner.publish(self._rest(batch))

    def replace(self, batch: DataFrame) -> None:
        self._inner.replace(self._rest(batch))


class _Countable(_Wrapped):
    def count(self, f: Filter) -> int:
        return self._inner.query(f).count()


def skip_matching(store: Store, skip: Column) -> Store:
    """The store, with events that match ``skip`` dropped before they are written."""
    return _Skipping(store, skip)  # type: ignore[return-value]


def count_by_query(store: Store) -> Store:
    """The store, with counts that are the length of the query's result, and so end at its limit."""
    return _Countable(store)  # type: ignore[return-value]


def without_search(store: Store) -> Store:
    """The store, with an empty result for filters that search; the given one stays as it is."""
    if isinstance(store, _Wrapped):
        out = object.__new__(type(store))
        out.__dict__.update(store.__dict__ | {"_inner": without_search(store._inner)})
        return out  # type: ignore[return-value]
    out = copy.copy(store)
    out.modes = Modes(store.modes.tag_match, "disabled", store.modes.id_match, store.modes.max_text)
    return out
