"""Exact dedup by progressive refinement: byte length, then hash of a prefix, then hash of the whole text.

One scan leaves length and prefix hash of each text; the first two steps group these and hand on the keys that at least two
texts share. While the keys that remain fit
a broadcast, which is counted first, the whole text is hashed, and moved, only where length and prefix both agree. Beyond that
bound Spark shuffles: ``exact_copies`` then hashes every text, and moves the hash; ``drop_exact_copies`` moves every text once.
Defined results:

* two null texts are not copies: what a null holds is unknown; such rows stay;
* empty texts are copies of each other; texts may be of any length;
* of the rows with one text the one with the smallest doc_id stays (a null id is the largest); among repeated rows one;
* ids are of any type that has an order; an empty table gives an empty table; other columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, fits, packed, stored

PREFIX_CHARS = 128
#: What a broadcast key takes.
KEY_BYTES = 24


def _suspects(rows: DataFrame) -> DataFrame:
    """Stored keys (size, head) that at least two texts share. The text column is read once; both steps then read the keys."""
    keys = stored(rows.where("text is not null").select("size", "head"), "keys")
    sizes = stored(keys.groupBy("size").count().where("count > 1").select("size"), "sizes")
    return stored(keys.join(bounded_broadcast(sizes, 16), "size", "left_semi").groupBy("size", "head").count().where("count > 1").select("size", "head"), "heads")


def _keyed(docs: DataFrame, text: str, id_col: str, prefix_chars: int) -> DataFrame:
    return packed(docs).select(
        "row",
        F.col(f"row.`{text}`").alias("text"),
        F.col(f"row.`{id_col}`").alias("id"),
        F.octet_length(f"row.`{text}`").alias("size"),
        F.xxhash64(F.substring(f"row.`{text}`", 1, prefix_chars)).alias("head"),
    )


def exact_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """A row for each document whose text occurs again: its id, the id that stays for the text, and how many rows have it."""
    rows = _keyed(docs, text, id_col, prefix_chars)
    keys = _suspects(rows)
    hashed = F.unhex(F.sha2("text", 256)).alias("full")
    if fits(keys, KEY_BYTES):
        full = rows.join(F.broadcast(keys), ["size", "head"], "left_semi").select("id", "size", hashed)
    else:  # the hash moves in place of the text
        full = rows.where("text is not null").select("id", "size", "head", hashed).join(keys, ["size", "head"], "left_semi")
    same = Window.partitionBy("size", "full")
    return (
        full.select(F.col("id").alias(id_col), F.min("id").over(same).alias("kept_id"), F.count(F.lit(1)).over(same).alias("copies"))
        .where("copies > 1")
    )


def drop_exact_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The documents with one row for each text."""
    rows = _keyed(docs, text, id_col, prefix_chars)
    keys = _suspects(rows)
    hashed = F.unhex(F.sha2("text", 256))
    by_id = F.col("id").asc_nulls_last()
    if fits(keys, KEY_BYTES):
        alone = rows.join(F.broadcast(keys), ["size", "head"], "left_anti").select("row")
        suspects = rows.join(F.broadcast(keys), ["size", "head"], "left_semi").select("row", "id", "size", hashed.alias("full"))
        one = suspects.withColumn("n", F.row_number().over(Window.partitionBy("size", "full").orderBy(by_id)))
    else:  # one shuffle by (size, head) serves the join and the window; only suspects are hashed
        alone = rows.where("text is null").select("row")
        marked = rows.where("text is not null").join(keys.withColumn("suspect", F.lit(True)), ["size", "head"], "left")
        marked = marked.withColumn("full", F.when(F.col("suspect"), hashed))
        one = marked.withColumn("n", F.row_number().over(Window.partitionBy("size", "head", "full").orderBy(by_id)))
    return alone.unionByName(one.where("n = 1").select("row")).select("row.*")


ORACLE = """
SELECT doc_id, kept_id, copies FROM (
 SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_id, count(*) OVER (PARTITION BY text) AS copies FROM documents WHERE text IS NOT NULL)
WHERE copies > 1
"""
