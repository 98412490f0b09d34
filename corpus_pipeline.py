"""Documents to packed training sequences: five stages, each written and read again before the next one.

Every stage takes any documents: nulls in any column, empty and very long texts, ties, repeated rows and empty tables have
the results that its function names; further columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact, jaccard, lines, mixing, packing
from tidemark.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line-first cleaning; documents that lose too much go, and so do null, empty and blank texts. Repeated rows are judged alike."""
    return lines.clean_lines(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays for each text, that of the smallest id (a null id is the largest); null texts all stay."""
    return exact.drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that n-gram Jaccard pairs connect, the document with the smallest id stays; of its repeated rows one. Texts without words stay."""
    return jaccard.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Balanced sampling to the sources' target weights; a null source is one, and texts without words have no tokens to balance."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of whole documents and pieces of long ones, with every token once; texts without words are in no bin."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram jaccard join", near_dedup),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Balanced sampling and packing are sequential; SQL has no form for them. Tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
