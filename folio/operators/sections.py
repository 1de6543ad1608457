"""Section operators: boilerplate subtree pruning, lead section, urls.

Sections of one page come from that page's own row, so the prune is a fold
over the row's section array (``aggregate``): no shuffle, and no group larger
than one page.  ``prune_flat`` does the same for a flat sections table with
window functions partitioned by page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.text import py_strip, section_url


def is_boilerplate(title) -> Column:
    """Title (stripped, lower-cased) is one of the dropped section names."""
    t = F.col(title) if isinstance(title, str) else title
    return F.coalesce(F.lower(py_strip(t)).isin(*config.BOILERPLATE_SECTIONS), F.lit(False))


def prune_boilerplate(sections: Column) -> Column:
    """Drop boilerplate sections *and their descendants* from a pre-order
    ``array<struct<ord, level, title, text>>``.

    The fold carries the level of the subtree being skipped (null when not
    skipping) and one flag a section; the sections themselves are copied once,
    by the final filter.  A section deeper than the cut level is skipped; any
    other section ends the skip.
    """
    init = F.struct(F.lit(None).cast("int").alias("cut"), F.lit("").alias("keep"))

    def step(acc, s):
        inside = acc["cut"].isNotNull() & (s["level"] > acc["cut"])
        boiler = is_boilerplate(s["title"])
        cut = F.when(inside, acc["cut"]).when(boiler, s["level"])
        return F.struct(cut.alias("cut"), F.concat(
            acc["keep"], F.when(inside | boiler, F.lit("0")).otherwise(F.lit("1"))).alias("keep"))

    flags = F.aggregate(sections, init, step, lambda acc: F.split(acc["keep"], ""))
    kept = F.filter(F.arrays_zip(sections.alias("s"), flags.alias("f")), lambda x: x["f"] == "1")
    return F.transform(kept, lambda x: x["s"])


def prune_flat(sections: DataFrame, page_col: str = "page_id", max_level: int = 6) -> DataFrame:
    """Prune a flat ``sections(page, ord, level, title, ...)`` table.

    A section is dropped when it is boilerplate, or when for some level ``l``
    below its own the last earlier section at level <= ``l`` is a boilerplate
    section at exactly level ``l`` (it is then inside that subtree).  One
    window (one sort) per page computes all running maxima.
    """
    w = Window.partitionBy(page_col).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    boiler = is_boilerplate("title")
    staged = sections.withColumn("_boiler", boiler)
    covered = F.lit(False)
    for lvl in range(1, max_level + 1):
        last_any = F.max(F.when(F.col("level") <= lvl, F.col("ord"))).over(w)
        last_boiler = F.max(F.when(F.col("_boiler") & (F.col("level") == lvl), F.col("ord"))).over(w)
        covered = covered | ((F.col("level") > lvl) & last_boiler.isNotNull()
                             & (last_boiler == last_any))
    return (staged.withColumn("_covered", covered)
                  .filter(~(F.col("_boiler") | F.col("_covered")))
                  .drop("_boiler", "_covered"))


def lead_first(lead: DataFrame, sections: DataFrame) -> DataFrame:
    """Lead section (``ord = -1``, no title, page url) ahead of the others;
    kept only when its stripped text is non-empty."""
    lead_rows = (lead.withColumn("text", py_strip(F.col("text")))
                     .filter(F.col("text") != "")
                     .withColumn("ord", F.lit(-1)).withColumn("level", F.lit(0))
                     .withColumn("title", F.lit(None).cast("string")))
    return lead_rows.unionByName(sections, allowMissingColumns=True)


def with_section_urls(sections: DataFrame, page_url_col: str = "page_url") -> DataFrame:
    return sections.withColumn("url", section_url(F.col(page_url_col), F.col("title")))


def flatten_tree(sections: DataFrame, prune: bool = True) -> DataFrame:
    """Parent-pointer sections -> pre-order.

    Input: ``page_id, node, parent (null for top level), ord`` (sibling
    order) and ``title`` plus any payload.  Output adds ``level`` (1 for top
    level) and ``pre`` (0-based pre-order position in the page); with
    ``prune`` a boilerplate section and its whole subtree are dropped.

    A page's nodes are gathered as one narrow array (bounded by the page) and
    walked with an explicit stack in an Arrow step, so neither the number of
    sections nor the depth of a tree is limited.  Siblings follow ``ord``, then
    ``node``; a node that no root reaches is dropped, and so are all copies of a
    node after its first visit.
    """
    node_type = sections.schema["node"].dataType.simpleString()
    page_type = sections.schema["page_id"].dataType.simpleString()
    nodes = (sections.select("page_id", "node", "parent", "ord", is_boilerplate("title").alias("boiler"))
             .groupBy("page_id")
             .agg(F.sort_array(F.collect_list(F.struct(
                 F.col("ord").alias("ord"), F.col("node").alias("node"),
                 F.col("parent").alias("parent"), F.col("boiler").alias("boiler")))).alias("nodes")))
    walked = nodes.mapInArrow(_walk_trees(prune),
                              f"page_id {page_type}, node {node_type}, level int, pre int")
    return sections.join(walked, ["page_id", "node"])


def _walk_trees(prune: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            page_type = batch.schema.field("page_id").type
            node_type = batch.schema.field("nodes").type.value_type.field("node").type
            page, node, level, pre = [], [], [], []
            for page_id, nodes in zip(batch.column(names.index("page_id")).to_pylist(),
                                      batch.column(names.index("nodes")).to_pylist()):
                below: dict = {}
                for n in nodes:
                    below.setdefault(n["parent"], []).append((n["node"], n["boiler"]))
                stack = [(n, b, 1) for n, b in reversed(below.get(None, ()))]
                seen, at = set(), 0
                while stack:
                    n, boiler, depth = stack.pop()
                    if n in seen or (prune and boiler):
                        continue
                    seen.add(n)
                    page.append(page_id)
                    node.append(n)
                    level.append(depth)
                    pre.append(at)
                    at += 1
                    if n is not None:
                        stack += [(c, b, depth + 1) for c, b in reversed(below.get(n, ()))]
            yield pa.record_batch([pa.array(page, page_type), pa.array(node, node_type),
                                   pa.array(level, pa.int32()), pa.array(pre, pa.int32())],
                                  ["page_id", "node", "level", "pre"])
    return run
