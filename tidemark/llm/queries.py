"""The driver's queries over the subpackage's operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import captures, exact, jaccard, licenses, lines, mixing, packing, preference, quality, repeats
from .common import table


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks as text, "start-end" joined by commas, so that both engines give them alike."""
    pairs = preference.format_pairs(preference.with_stale_answer(table(spark, sf_dir, "conversations")))
    mask = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",").alias(c)
    return pairs.select(F.col("id").alias("conv_id"), "prompt_turns", "prompt", "chosen", mask("chosen_mask"), "rejected", mask("rejected_mask"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_spans(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_copies(table(spark, sf_dir, "documents"))


def op5_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_chars")


def op6_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.index_and_look_up(table(spark, sf_dir, "pages"))


def op7_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.clean_lines(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_preference_format, op2_ngram_jaccard_join, op3_suffix_array_dedup, op4_exact_dedup, op5_cube_mixing, op6_capture_index, op7_license_templates, op8_quality_cnn, op9_best_fit_packing, op10_line_cleaning)}

ORACLES = {
    "op1_preference_format": preference.ORACLE,
    "op2_ngram_jaccard_join": jaccard.ORACLE,
    "op3_suffix_array_dedup": repeats.ORACLE,
    "op4_exact_dedup": exact.ORACLE,
    "op6_capture_index": captures.oracle(),
    "op7_license_templates": licenses.oracle(),
    "op10_line_cleaning": lines.oracle(),
}
