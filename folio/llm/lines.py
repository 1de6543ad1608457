"""Line dedup by distinct-site spread.

Every line hash gets a HyperLogLog sketch of the sites it occurs on; sketches
are merged by aggregation, before and after the shuffle.  Lines whose estimate
is clearly below or above the threshold are decided by it; those near it are
counted exactly.  Lines on too many sites are boilerplate: they stay in the
first document (least doc_id) that has them and go from all others.  DataFrame
operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import drop_table, stage_table

MIN_SITES = 10
MARGIN = 0.25  # of the threshold; the sketch's standard error is about 1.6 %
LOG_SIZE = 12

_BLANKS = " \t\r\x0b\f"


def line_key(line: Column) -> Column:
    """128 bits for a line without outer white space; null for a blank line."""
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"),
                                       F.xxhash64(F.lit(1), bare).alias("b")))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, site, body, place, key) of the lines that are not blank."""
    return (docs.select("doc_id", F.col("_site").alias("site"), F.xxhash64("text").alias("body"),
                        F.posexplode(F.split("text", "\n")).alias("place", "line"))
            .select("doc_id", "site", "body", "place", line_key(F.col("line")).alias("key"))
            .where("key is not null"))


def boilerplate(lines: DataFrame, min_sites: int, margin: float = MARGIN) -> DataFrame:
    """(key, first) of the lines on at least ``min_sites`` sites, staged."""
    spread = (lines.groupBy("key")
              .agg(F.hll_sketch_agg("site", LOG_SIZE).alias("sketch"),
                   F.min("doc_id").alias("first"))
              .withColumn("sites", F.hll_sketch_estimate("sketch"))
              .where(F.col("sites") >= min_sites * (1 - margin))
              .select("key", "first", "sites"))
    spread = stage_table(spread, "spread")
    sure = F.col("sites") > min_sites * (1 + margin)
    near = spread.where(~sure).select("key")
    exact = (lines.join(near, "key", "left_semi").select("key", "site").distinct()
             .groupBy("key").agg(F.count("site").alias("exact"))
             .where(F.col("exact") >= min_sites).select("key"))
    out = stage_table(
        spread.where(sure).select("key", "first")
        .union(spread.where(~sure).join(exact, "key", "left_semi").select("key", "first")),
        "boilerplate")
    drop_table(spread)
    return out


def line_dedup(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES,
               margin: float = MARGIN, keep: list[str] | None = None) -> DataFrame:
    """Remove lines that spread over at least ``min_sites`` distinct sites.

    ``docs`` has ``doc_id``, ``text`` and the site column; other columns are
    ignored.  Lines end at line feeds and are compared without outer ASCII white
    space; blank lines are never counted or removed.  A null site counts as no
    site.  A null text stays null and has no lines; an empty text is one blank
    line.  All occurrences in the first document stay.  Repeated rows are
    treated alike; rows with a null ``doc_id`` lose nothing; an empty table
    gives an empty result.

    Returns doc_id, n_lines, n_removed, text (what is kept), and the columns
    named in ``keep``, which must bear other names.
    """
    keep = keep or []
    docs = docs.select(*keep,F.col("doc_id").cast("long").alias("doc_id"),
                       F.col(site).cast("string").alias("_site"),
                       F.col("text").cast("string").alias("text"))
    lines = stage_table(lines_of(docs), "lines")  # hashes only, read several times
    spread = boilerplate(lines, min_sites, margin)
    marks = stage_table(lines.select("doc_id", "body", "place", "key")
                        .join(spread, "key").where("doc_id > first")
                        .groupBy("doc_id", "body").agg(F.collect_set("place").alias("_gone")), "marks")
    drop_table(lines)
    drop_table(spread)
    split = F.split("text", "\n")
    kept = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return (docs.withColumn("_body", F.xxhash64("text"))
            .join(marks.withColumnsRenamed({"doc_id": "_doc", "body": "_place"}),
                  (F.col("doc_id") == F.col("_doc")) & (F.col("_body") == F.col("_place")), "left")
            .select(*keep, "doc_id",
                    F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"),
                    F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long")
                    .alias("n_removed"),
                    F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept).alias("text")))
