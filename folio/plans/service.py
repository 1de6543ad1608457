"""The retrieval service, batch first.

``Retrieval`` ties the pieces together over a versioned ``ChunkStore`` and a
pages table:

* ``ensure_indexed(topics)`` - resolve the topics to pages (exact title, else
  first letter upper-cased), ingest only the topics with no stored row, in
  one job for all of them;
* ``reingest(topics, mode)`` - ``"merge"`` upserts by key and keeps stale
  chunks (the behaviour of the system this reproduces), ``"replace"``
  swaps each topic's chunks wholesale;
* ``purge(topics)``;
* ``get_chunks(requests)`` - ensure indexed, then exact (or approximate)
  top-k with citations, and the requests that got none with the reason.

Unresolvable topics and topics that produce no sections or no chunks come
back as rejects with a reason instead of failing the batch; a single call
raises ``RetrievalError``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import INGEST_CHUNKS, ChunkOptions, EmbedOptions, SearchOptions
from ..functions.text import py_strip
from ..operators import store as st
from ..operators.search import RetrievalError, search, single_request, validate_requests
from ..sources.pages import lookup_pages, page_sections, page_titles
from .ingest import PLACE, first_sections, sections_to_chunks


class Retrieval:
    def __init__(self, spark: SparkSession, chunk_store: st.ChunkStore, pages: DataFrame, *,
                 chunk_options: ChunkOptions = INGEST_CHUNKS,
                 embed_options: EmbedOptions = EmbedOptions(),
                 search_options: SearchOptions = SearchOptions(),
                 key: tuple = ("topic", "chunk_id"), titles: DataFrame | None = None,
                 lang: str | None = None):
        """``titles``: a stored ``page_titles(pages)`` table; without it the
        titles are extracted from the markup on every lookup."""
        self.spark = spark
        self.store = chunk_store
        self.pages = pages
        self.titles = titles
        self.lang = lang
        self.chunk_options = chunk_options
        self.embed_options = embed_options
        self.search_options = search_options
        self.key = key

    # -- building ---------------------------------------------------------
    def _topics(self, topics: DataFrame) -> DataFrame:
        return (topics.select(py_strip(F.col("topic")).alias("topic"))
                      .filter(F.col("topic") != "").distinct())

    def resolve(self, topics: DataFrame) -> DataFrame:
        """``(topic, page_id, title, status)`` per requested topic."""
        titles = self.titles if self.titles is not None else page_titles(self.pages)
        cols = ["page_id", "title"] + (["lang"] if self.lang is not None else [])
        return lookup_pages(self._topics(topics), titles.select(*cols), lang=self.lang)

    def build(self, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(store rows, rejects) for the given topics.  Rows are stored under
        the requested topic string, titled with the page title."""
        resolved = self.resolve(topics)
        found = resolved.filter(F.col("status").isin("exact", "capitalized"))
        secs = page_sections(self.pages.join(found.select("page_id").distinct(), "page_id",
                                             "left_semi"))
        secs = secs.drop("topic").join(found.select("page_id", "topic"), "page_id")
        rows = sections_to_chunks(secs, self.chunk_options, self.embed_options, extra=PLACE)
        made = rows.select("topic").distinct().withColumn("_made", F.lit(True))
        cut = secs.select("topic").distinct().withColumn("_cut", F.lit(True))
        reason = (F.when(F.col("status") == "not found", F.lit("page not found"))
                   .when(F.col("_cut").isNull(), F.lit("no sections"))
                   .otherwise(F.lit("no chunks produced")))
        rejects = (resolved.join(made, "topic", "left").join(cut, "topic", "left")
                   .filter(F.col("_made").isNull()).select("topic", reason.alias("reason")))
        return first_sections(rows, self.key), rejects

    def _stored(self, topics: DataFrame, prune_topics: int = 1000) -> DataFrame:
        """The stored chunks; of the topics' buckets only, if there are few topics."""
        names = topics.limit(prune_topics + 1).collect()
        if len(names) > prune_topics:
            return self.store.read()
        return self.store.read_topics([r.topic for r in names])

    # -- maintenance --------------------------------------------------------
    def ensure_indexed(self, topics: DataFrame) -> DataFrame:
        """Ingest the missing topics; returns the rejects."""
        wanted = self._topics(topics)
        missing = st.missing_topics(wanted, self._stored(wanted))
        if missing.limit(1).count() == 0:
            return self.spark.createDataFrame([], "topic string, reason string")
        rows, rejects = self.build(missing)
        rows = st.materialize(rows)  # the ingest pipeline runs once
        if rows.limit(1).count() > 0:  # nothing resolvable: no new version
            self.store.upsert(rows, self.key, materialized=True)
        return rejects

    def reingest(self, topics: DataFrame, mode: str = "merge") -> DataFrame:
        rows, rejects = self.build(topics)
        if mode == "merge":
            self.store.upsert(rows, self.key)
        elif mode == "replace":
            self.store.replace(rows)
        else:
            raise ValueError("mode must be 'merge' or 'replace'")
        return rejects

    def purge(self, topics: DataFrame) -> int:
        return self.store.purge(self._topics(topics))

    # -- retrieval ----------------------------------------------------------
    def get_chunks(self, requests: DataFrame, *, prune_topics: int = 1000,
                   **kw) -> tuple[DataFrame, DataFrame]:
        """Ensure indexed, then search: (hits, rejects).

        Every request is answered in one of the two: rejects carry the request
        and its reason (bad argument, page not found, no sections, no chunks).
        When the batch names at most ``prune_topics`` topics, only their buckets
        are read."""
        requests = st.materialize(requests)  # read several times below
        valid, bad = validate_requests(requests)
        failed = self.ensure_indexed(valid.select("topic"))
        rejects = (bad.select("query_id", "topic", "reason")
                   .unionByName(valid.join(failed, "topic").select("query_id", "topic", "reason")))
        chunks = self._stored(self._topics(valid), prune_topics)
        kw.setdefault("late_payload", True)  # chunks come from the store
        hits = search(chunks, valid, embed_options=self.embed_options,
                      options=self.search_options, **kw)
        return hits, rejects

    def get_chunks_one(self, topic: str, query: str | None = None, k: int = 6) -> DataFrame:
        req = single_request(self.spark, topic, query, k)
        hits, rejects = self.get_chunks(req)
        first = rejects.first()
        if first is not None:
            raise RetrievalError(f"get_chunks failed: {first['reason']}")
        return hits.orderBy("rank")
