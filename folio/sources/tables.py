"""Scans of the input tables and their mapping onto pages and sections.

``documents`` stand in for page sections: the topic (page) is ``source``, the
section title is ``'doc ' || doc_id``, the url is the page url of the topic in
the document's language plus the section anchor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import page_url, section_url

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str | None = None, per_slot: int = 1) -> DataFrame:
    """Hash-spread a scan over the cluster when it yields fewer partitions than
    there are task slots (small inputs stored as one row group).  On large
    inputs the scan already has more splits than slots and this is a no-op,
    so it never adds a shuffle at scale.  Hashing on a key keeps the placement
    deterministic when a lost task is recomputed."""
    slots = df.sparkSession.sparkContext.defaultParallelism * per_slot
    try:
        parts = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view (e.g. remote sessions)
        return df
    if parts >= slots:
        return df
    return df.repartition(slots, key) if key else df.repartition(slots)


def document_sections(documents: DataFrame) -> DataFrame:
    """``documents`` -> ``sections(page_id, topic, lang, page_title, ord, level,
    title, text, url)``."""
    title = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    purl = page_url(F.col("source"), F.col("lang"))
    return documents.select(
        F.col("doc_id").alias("page_id"),
        F.col("source").alias("topic"),
        F.col("lang"),
        F.col("source").alias("page_title"),
        F.col("doc_id").cast("int").alias("ord"),
        F.lit(1).alias("level"),
        title.alias("title"),
        F.col("text"),
        section_url(purl, title).alias("url"))


def document_requests(documents: DataFrame) -> DataFrame:
    """Every document asks for the passages closest to its whole text within
    its topic; k is 4, 5 or 6."""
    return documents.select(
        F.col("doc_id").alias("query_id"),
        F.col("source").alias("topic"),
        F.col("text").alias("query"),
        (F.lit(4) + F.pmod(F.col("doc_id"), F.lit(3))).cast("int").alias("k"))
