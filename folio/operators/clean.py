"""Section cleaning: ``sections -> sections`` with cleaned text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.text import clean_text


def clean_sections(sections: DataFrame, text_col: str = "text") -> DataFrame:
    """Clean every section's text and drop those shorter than 80 characters.

    Same shape in and out; row-local (no shuffle).
    """
    # The cleaned text is produced by an outer generator over a 0/1-element
    # array: a plain filter on a cleaned column would be pushed below the
    # projection and run the regex chain twice (and below any repartition).
    others = [c for c in sections.columns if c != text_col]
    kept = F.filter(F.array(clean_text(F.col(text_col))),
                    lambda t: F.length(t) >= config.CLEAN_MIN_CHARS)
    cleaned = sections.select(*others, F.explode_outer(kept).alias(text_col))
    return cleaned.filter(F.col(text_col).isNotNull()).select(*sections.columns)


def dropped_sections(sections: DataFrame, text_col: str = "text") -> DataFrame:
    """The sections ``clean_sections`` drops, with their cleaned length."""
    cleaned = sections.withColumn("cleaned_chars", F.length(clean_text(F.col(text_col))))
    return cleaned.filter(F.col("cleaned_chars") < config.CLEAN_MIN_CHARS)
