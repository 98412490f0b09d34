"""Tokens and normal forms of text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def tokenise(text: str) -> list[str]:
    """The same for one query string, without duplicates."""
    out = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text.lower()).split()
    return list(dict.fromkeys(out))


def nfkc(text: Column | str) -> Column:
    """Compatibility normal form, by the ICU that Spark has for its collations: row by row, so that nothing is held in Python."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.isNotNull(), F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True)))
