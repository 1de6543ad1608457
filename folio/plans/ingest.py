"""Ingest plan: sections -> clean -> chunk -> embed -> provenance -> chunk rows.

One DataFrame plan for every topic at once; its only shuffle-free stages run
fused with the scan.  Writing goes through ``operators.store``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..config import INGEST_CHUNKS, ChunkOptions, EmbedOptions
from ..operators.chunk import chunk_sections
from ..operators.clean import clean_sections
from ..operators.embed import hash_embed, tokens_embed
from ..operators.store import dedup_new

STORE_COLUMNS = ("chunk_id", "topic", "text", "tokens", "embedding_model", "url", "title",
                 "section", "ingested_at", "embedding")


def add_provenance(chunks: DataFrame, embed_options: EmbedOptions, ingested_at=None,
                   extra: tuple = ()) -> DataFrame:
    """Topic, page title, model name and ingest time on every chunk, with the
    store's column defaults (null section and missing strings -> '')."""
    ts = ingested_at if ingested_at is not None else F.unix_timestamp()
    return chunks.select(
        "chunk_id", "topic", "text",
        F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens"),
        F.lit(embed_options.model_name).alias("embedding_model"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        F.coalesce(F.col("page_title"), F.lit("")).alias("title"),
        F.coalesce(F.col("section"), F.lit("")).alias("section"),
        F.coalesce(ts.cast("long"), F.unix_timestamp()).alias("ingested_at"),
        "embedding", *extra)


class IngestCounts:
    """What an ingest read, kept and dropped, counted by the job that writes its rows.

    Give it to ``sections_to_chunks`` (once), run the result, then read ``row()``:
    no second scan of the sections.
    """

    def __init__(self):
        self.read, self.cleaned, self.cut, self.kept = (Observation() for _ in range(4))

    def row(self) -> dict:
        """Waits for the first action on the observed rows."""
        sections, kept = self.read.get["sections"], self.cleaned.get["sections"]
        pieces, chunks = self.cut.get["pieces"], self.kept.get["chunks"]
        return {"sections": sections, "kept_sections": kept, "dropped_sections": sections - kept,
                "pieces": pieces, "chunks": chunks, "dropped_pieces": pieces - chunks}


def sections_to_chunks(sections: DataFrame, chunk_options: ChunkOptions = INGEST_CHUNKS,
                       embed_options: EmbedOptions = EmbedOptions(), *,
                       ingested_at=None, clean: bool = True, tokenizer=None,
                       extra: tuple = (), counts: IngestCounts | None = None) -> DataFrame:
    """Sections (topic, page_title, title, text, url) -> store rows.

    ``counts`` takes the numbers of sections and pieces kept and dropped.
    ``extra`` columns of the sections come along, for example ``page_id`` and
    ``ord``, by which ``first_sections`` settles rows with the same key."""
    if counts is not None:
        sections = sections.observe(counts.read, F.count(F.lit(1)).alias("sections"))
    cleaned = clean_sections(sections) if clean else sections
    if counts is not None:
        cleaned = cleaned.observe(counts.cleaned, F.count(F.lit(1)).alias("sections"))
    cut = counts.cut if counts is not None else None
    if tokenizer is None:
        # tokens come with the windows: one tokenize, and one hash per distinct token of a batch
        chunks = chunk_sections(cleaned, chunk_options, keep=("topic", "page_title", *extra),
                                observe=cut, window_tokens=True)
        embedded = chunks.withColumn("embedding", tokens_embed("window_tokens", embed_options))
    else:
        chunks = chunk_sections(cleaned, chunk_options, keep=("topic", "page_title", *extra),
                                tokenizer=tokenizer, observe=cut)
        embedded = chunks.withColumn("embedding", hash_embed(F.col("text"), embed_options))
    rows = add_provenance(embedded, embed_options, ingested_at, extra)
    return rows if counts is None else rows.observe(counts.kept, F.count(F.lit(1)).alias("chunks"))


PLACE = ("page_id", "ord")


def first_sections(rows: DataFrame, key: tuple = ("topic", "chunk_id")) -> DataFrame:
    """Of the rows of one batch with the same key (same-named sections of a page)
    the one of the first section stays; ``store.dropped_rows`` counts the others."""
    return dedup_new(rows, key, PLACE).drop(*PLACE)
