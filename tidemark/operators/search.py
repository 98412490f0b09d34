"""Ranked full-text search over an inverted index that is itself a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfkc, tokenise, tokens

K1, B = 1.2, 0.75


def build_index(events: DataFrame, id_col: str = "id", text: str = "content", normalise: bool = False) -> DataFrame:
    """Rows (term, id, tf, size): how often a term is in a text, and how many terms the text has. Store it sorted by term."""
    content = nfkc(F.col(text)) if normalise else F.col(text)
    rows = events.select(F.col(id_col).alias("id"), tokens(content).alias("ws"))
    return rows.select("id", F.size("ws").alias("size"), F.explode("ws").alias("term")).groupBy("term", "id", "size").agg(F.count(F.lit(1)).alias("tf"))


def corpus_size(events: DataFrame, text: str = "content") -> DataFrame:
    """One row: the number of texts and the terms of an average one."""
    size = F.size(tokens(F.col(text)))
    return events.agg(F.count(F.lit(1)).alias("docs"), F.avg(size).alias("average"))


def ranked(index: DataFrame, corpus: DataFrame, query: str, limit: int = 40) -> DataFrame:
    """(id, score) of the best texts by BM25; a query of fewer than two bytes finds nothing."""
    terms = tokenise(query)
    if len(query.encode()) < 2 or not terms:
        return index.select("id", F.lit(0.0).alias("score")).limit(0)
    hits = index.where(F.col("term").isin(*terms))  # reaches the scan of a stored index
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # as many rows as the query has terms
    joined = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(corpus))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("average")))
    return joined.groupBy("id").agg(F.round(F.sum(idf * weight), 6).alias("score")).orderBy(F.desc("score"), F.asc("id")).limit(limit)


def with_events(hits: DataFrame, events: DataFrame) -> DataFrame:
    """The hits' events, best first; hits whose event is gone are dropped. Hits are a top-k of bounded size."""
    return events.join(F.broadcast(hits), "id").orderBy(F.desc("score"), F.asc("id"))
