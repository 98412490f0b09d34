"""Counts and distinct authors, exact and by sketches that can be kept and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.filters import Filter
from ..plans.predicates import Modes, matching

#: Which tag a cached sketch of a kind refers to.
REFERENCES = {3: "p", 7: "e", 1111: "E"}
REGISTERS = 256


def count(events: DataFrame, f: Filter, modes: Modes = Modes()) -> DataFrame:
    """One row ``n``; the limit plays no part."""
    return matching(events, f.check(), modes).agg(F.count(F.lit(1)).alias("n"))


def count_authors(events: DataFrame, f: Filter, modes: Modes = Modes()) -> DataFrame:
    """Events and exactly counted authors."""
    return matching(events, f.check(), modes).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pubkey").alias("authors"))


def sketch_authors(events: DataFrame, f: Filter, modes: Modes = Modes()) -> DataFrame:
    """Events and a mergeable sketch of their authors."""
    return matching(events, f.check(), modes).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("pubkey").alias("sketch"))


def register_and_rank(offset: int, pubkey: str = "pubkey") -> tuple[Column, Column]:
    """The register that an author falls into (the byte at ``offset``) and one more than the zero bits that follow it."""
    register = F.conv(F.substring(pubkey, 2 * offset + 1, 2), 16, 10).cast("int")
    bits = F.conv(F.rpad(F.substring(pubkey, 2 * offset + 3, 16), 16, "0"), 16, 2)
    return register, F.when(bits == "0", 65).otherwise(65 - F.length(bits)).cast("int")


def registers(events: DataFrame, f: Filter, offset: int, modes: Modes = Modes()) -> DataFrame:
    """The non-empty registers of the authors' HyperLogLog, as rows (register, rank)."""
    register, rank = register_and_rank(offset)
    return matching(events, f.check(), modes).groupBy(register.alias("register")).agg(F.max(rank).alias("rank"))


def estimate(rows: DataFrame) -> DataFrame:
    """The estimate that rows (register, rank) stand for; linear counting while registers are empty and it is small."""
    m = float(REGISTERS)
    agg = rows.agg((F.lit(m) - F.count(F.lit(1))).alias("empty"), F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0)).alias("s"))
    raw = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / (F.col("s") + F.col("empty"))
    return agg.select(F.round(F.when((raw <= 2.5 * m) & (F.col("empty") > 0), F.lit(m) * F.log(F.lit(m) / F.greatest("empty", F.lit(1.0)))).otherwise(raw)).cast("bigint").alias("authors"))


def _named(events: DataFrame, references: dict[int, str]) -> DataFrame:
    """Rows (id, kind, pubkey, ref): each event once with each value of its kind's reference tag, null for a tag without one."""
    kinds = events.where(F.col("kind").isin(*references))
    key = F.create_map(*[x for k, v in references.items() for x in (F.lit(k), F.lit(v))])
    named = kinds.select("id", "kind", "pubkey", F.explode("tags").alias("t"), key[F.col("kind")].alias("k"))
    return named.where(F.get("t", F.lit(0)) == F.col("k")).select("id", "kind", "pubkey", F.get("t", F.lit(1)).alias("ref")).distinct()


def author_sketches(events: DataFrame, references: dict[int, str] = REFERENCES) -> DataFrame:
    """Rows (kind, ref, n, sketch): for each kind, what each value of its reference tag was named by."""
    refs = _named(events, references).where("ref is not null")
    return refs.groupBy("kind", "ref").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("pubkey").alias("sketch"))


def author_sets(events: DataFrame, references: dict[int, str] = REFERENCES) -> DataFrame:
    """Rows (kind, ref, pubkey, n): what a sketch estimates, kept exactly; a row for each author of a reference, also of a null one."""
    return _named(events, references).groupBy("kind", "ref", "pubkey").agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(*caches: DataFrame) -> DataFrame:
    """One cache of several, whose events must be disjoint for ``n`` to be exact."""
    rows = caches[0]
    for cache in caches[1:]:
        rows = rows.unionByName(cache)
    return rows.groupBy("kind", "ref").agg(F.sum("n").alias("n"), F.hll_union_agg("sketch").alias("sketch"))


def merge_sets(*caches: DataFrame) -> DataFrame:
    """Rows (kind, ref, n, authors), exactly counted over several caches, whose events must be disjoint."""
    rows = caches[0]
    for cache in caches[1:]:
        rows = rows.unionByName(cache)
    return rows.groupBy("kind", "ref").agg(F.sum("n").alias("n"), F.countDistinct("pubkey").alias("authors"))


def read_sketches(cache: DataFrame, kind: int, ref: str) -> DataFrame:
    return cache.where((F.col("kind") == kind) & (F.col("ref") == ref)).select("n", F.hll_sketch_estimate("sketch").alias("authors"))


def tag_counts(events: DataFrame) -> DataFrame:
    """How many events of each kind, and by how many authors."""
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pubkey").alias("authors"))
