"""Write semantics as transformations of the whole table; a store or a stream decides where the result goes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tags import first_value
from ..model import ADDRESSABLE, EPHEMERAL, REGULAR, REPLACEABLE, complete, kind_class, malformed, within_bounds


@dataclass
class Saved:
    """What a write did: the table after it, what was new, what was there before, and what broke a bound."""

    events: DataFrame
    inserted: DataFrame
    duplicates: DataFrame
    rejected: DataFrame


def validated(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events within bounds, and the rest."""
    rows = complete(batch)
    fine = F.coalesce(~malformed() & within_bounds(), F.lit(False))
    return rows.where(fine), rows.where(~fine)


def known_ids(events: DataFrame, batch: DataFrame, small: bool = False) -> DataFrame:
    """The batch's ids that the table has. With ``small``, the batch's ids are broadcast and the table is not shuffled."""
    own = batch.select("id")
    return events.select("id").join(F.broadcast(own) if small else own, "id", "left_semi").distinct()


def save(events: DataFrame, batch: DataFrame, skip: Column | None = None, small: bool = False) -> Saved:
    """Adds the events whose id is new. ``skip`` drops events before they are looked at; ``small`` says that the batch's
    ids may be broadcast, which a store knows by counting it."""
    good, rejected = validated(batch if skip is None else batch.where(~F.coalesce(skip, F.lit(False))))
    once = good.dropDuplicates(["id"])
    # Known ids are at most as many as the batch's: only they, not the table's, meet the batch.
    marked = once.join(known_ids(events, once, small).withColumn("__known", F.lit(True)), "id", "left")
    new = marked.where("__known is null").select(*events.columns)
    known = marked.where("__known").select(*events.columns)
    return Saved(events.unionByName(new), new, known, rejected)


def newest_first() -> list[Column]:
    """The order in which one event replaces another: later, then smaller id."""
    return [F.desc("created_at"), F.asc("id")]


def replacement_key() -> list[Column]:
    d = F.when(kind_class() == ADDRESSABLE, first_value("d")).otherwise(F.lit(""))
    return [F.col("pubkey"), F.col("kind"), d]


def latest(events: DataFrame, key: list[Column] | None = None) -> DataFrame:
    """The event that stands for each key. The choice is a maximum, so the order of arrival plays no part."""
    place = Window.partitionBy(*(key or replacement_key())).orderBy(*newest_first())
    return events.withColumn("__place", F.row_number().over(place)).where("__place = 1").drop("__place")


def replace(events: DataFrame, batch: DataFrame, skip: Column | None = None) -> DataFrame:
    """The table after the batch's replaceable and addressable events took the place of older ones."""
    good, _ = validated(batch if skip is None else batch.where(~F.coalesce(skip, F.lit(False))))
    both = events.unionByName(good.select(*events.columns))
    moved = kind_class().isin(REPLACEABLE, ADDRESSABLE)
    return both.where(~moved).dropDuplicates(["id"]).unionByName(latest(both.where(moved)))


def publish(events: DataFrame, batch: DataFrame, skip: Column | None = None) -> DataFrame:
    """The table after a batch of any kinds: ephemeral events go, regular ones are added once, the others replace."""
    good, _ = validated(batch if skip is None else batch.where(~F.coalesce(skip, F.lit(False))))
    new = good.where(kind_class() != EPHEMERAL).select(*events.columns)
    both = events.unionByName(new)
    regular = both.where(kind_class() == REGULAR).dropDuplicates(["id"])
    moved = latest(both.where(kind_class().isin(REPLACEABLE, ADDRESSABLE)))
    kept = events.where(kind_class() == EPHEMERAL)
    return regular.unionByName(moved).unionByName(kept)


def delete(events: DataFrame, ids: DataFrame) -> DataFrame:
    """The table without the events of these ids; unknown ids do nothing."""
    return events.join(ids.select("id"), "id", "left_anti").select(*events.columns)


def retain(events: DataFrame, keep: int = 100) -> DataFrame:
    """The table without what is older than each author's event number ``keep`` + 1."""
    place = Window.partitionBy("pubkey").orderBy(*newest_first())
    bound = F.max(F.when(F.col("__place") == keep + 1, F.col("created_at"))).over(Window.partitionBy("pubkey"))
    return events.withColumn("__place", F.row_number().over(place)).withColumn("__bound", bound).where("__bound is null or created_at >= __bound").drop("__place", "__bound")


def replace_same_content(events: DataFrame, kind: int = 2) -> DataFrame:
    """For kinds that are replaced by content: the latest of each author and content stays."""
    return events.where(F.col("kind") != kind).unionByName(latest(events.where(F.col("kind") == kind), [F.col("pubkey"), F.col("content")]))
