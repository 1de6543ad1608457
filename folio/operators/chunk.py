"""Token-window chunking: ``sections -> chunks``.

Per section: strip, drop empty or short text, tokenize, cut windows of
``max_tokens - 2`` tokens every ``step`` tokens, decode each window, drop short
pieces, and give each piece a stable id
``sha1(url | section title or '' | start | end)``.

Everything is row-local: no shuffle.  The windows are built with their text
inside one ``transform`` before ``inline``, so an output row never carries the
section's whole token array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..config import ChunkOptions
from ..functions.text import py_strip
from ..functions.tokens import tokenize, window_pieces


def chunk_id(url, section, a, b):
    """Stable id; ``concat_ws`` skips nulls, hence the coalesces."""
    return F.sha1(F.concat_ws("|", F.coalesce(url, F.lit("")), F.coalesce(section, F.lit("")),
                              a.cast("string"), b.cast("string")))


def chunk_sections(sections: DataFrame, options: ChunkOptions = ChunkOptions(), *,
                   text_col: str = "text", title_col: str = "title", url_col: str = "url",
                   keep: tuple = (), tokenizer=None, bucket_dim: int | None = None,
                   keep_case: bool = False, observe=None, window_tokens: bool = False) -> DataFrame:
    """Chunk sections.

    Output columns: ``keep`` columns, ``chunk_id, text, tokens, section, url,
    a, b`` (``a``/``b`` the token span).  ``tokenizer`` may be a Column
    function text -> array<string> (for example an Arrow UDF wrapping a user
    tokenizer); the default is the built-in regex tokenizer.

    ``keep_case``: chunk text keeps the original case (tokens are only
    lower-cased for hashing); by default the text is the lower-cased tokens.

    ``observe``: an ``Observation`` that counts the ``pieces`` cut, short ones too.

    ``bucket_dim``: also emit ``buckets``, the hash bucket of every token of
    the window, so the hashing encoder does not re-tokenize chunk text.  (A
    window's text re-tokenizes to exactly its token slice, so the vectors are
    the same.)

    ``window_tokens``: emit the window's lower-cased tokens themselves as ``window_tokens``
    instead, for an encoder that hashes them in Arrow batches (``embed.tokens_embed``).
    """
    from .embed import bucket_of
    tok = tokenizer or (lambda c: tokenize(c, lower=not keep_case))
    staged = (sections
              .withColumn("_raw", py_strip(F.coalesce(F.col(text_col), F.lit(""))))
              # tokens are a column of their own: referenced inside the window
              # lambda, an inline expression would be re-evaluated per window
              .withColumn("_toks", tok(F.col("_raw"))))
    if window_tokens:
        per_token = F.lower if keep_case else (lambda w: w)
    elif bucket_dim:
        per_token = (lambda w: bucket_of(F.lower(w), bucket_dim)) if keep_case else \
            (lambda w: bucket_of(w, bucket_dim))
    else:
        per_token = None
    staged = staged.withColumn("_pieces", F.when(
        (F.col("_raw") != "") & (F.length("_raw") >= options.min_chars),
        window_pieces(F.col("_toks"), options.window, options.step, per_token)))
    # The short-text test lives inside the generator input and the generator
    # is an outer one: Catalyst then has no filter to push (or infer) below
    # it, so cleaning and tokenizing run once per section, after any spread.
    exploded = staged.select(
        *keep,
        F.col(title_col).alias("section"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.inline_outer("_pieces"))
    if observe is not None:
        exploded = exploded.observe(observe, F.count_if(F.col("text").isNotNull()).alias("pieces"))
    pieces = exploded.filter(F.length("text") >= options.min_chars)
    return pieces.select(
        *keep,
        chunk_id(F.col("url"), F.col("section"), F.col("a"), F.col("b")).alias("chunk_id"),
        F.col("text"),
        (F.col("b") - F.col("a") + config.SPECIAL_TOKENS).cast("long").alias("tokens"),
        F.col("section"),
        F.col("url"),
        F.col("a"),
        F.col("b"),
        *([F.col("aligned").alias("window_tokens")] if window_tokens else
          [F.col("aligned").alias("buckets")] if bucket_dim else []))


def dropped_pieces(sections: DataFrame, options: ChunkOptions = ChunkOptions(), *,
                   text_col: str = "text") -> DataFrame:
    """Count of window pieces lost to the length floor (the tail-loss trap)."""
    staged = (sections
              .withColumn("_raw", py_strip(F.coalesce(F.col(text_col), F.lit(""))))
              .withColumn("_toks", tokenize(F.col("_raw")))
              .select(F.inline_outer(F.when(
                  (F.col("_raw") != "") & (F.length("_raw") >= options.min_chars),
                  window_pieces(F.col("_toks"), options.window, options.step)))))
    return staged.filter(F.length("text") < options.min_chars)
