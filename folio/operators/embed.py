"""Text -> vector.

Default model: signed-free feature hashing of tokens into ``dim`` buckets
(``pmod(hex-prefix of sha1(token), dim)``), L2-normalised.  Tokens go to one
numpy step over whole Arrow batches, which hashes each distinct token once and
counts the buckets of a row.  It is row-local, so embedding adds no shuffle; the alternative
(explode every token, ``groupBy(chunk, bucket)``) would shuffle one row per
token.

A real model plugs in through ``embed_with_model``: ``mapInPandas`` loads it
once per task and encodes Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EmbedOptions
from ..functions.tokens import tokenize
from ..functions.vectors import EPS, l2_norm, scale


def bucket_of(token: Column, dim: int) -> Column:
    """Token -> bucket: the first 8 hex digits of its sha1, modulo ``dim``."""
    return F.pmod(F.conv(F.substring(F.sha1(token), 1, 8), 16, 10).cast("bigint"),
                  F.lit(dim)).cast("int")


def token_buckets(text, dim: int, max_len: int | None = None, tokenizer=None) -> Column:
    """Text -> ``array<int>`` of hash buckets, one per token."""
    toks = (tokenizer or tokenize)(F.col(text) if isinstance(text, str) else text)
    if max_len:
        toks = F.slice(toks, 1, max_len)
    return F.transform(toks, lambda w: bucket_of(w, dim))


def buckets_embed(buckets, options: EmbedOptions = EmbedOptions()) -> Column:
    """Bucket ids (already cut per chunk) -> embedding column."""
    b = F.col(buckets) if isinstance(buckets, str) else buckets
    if options.max_seq_length:
        b = F.slice(b, 1, options.max_seq_length)
    return hashed_vector(b, options.dim, options.normalize)


def _token_bucket_ids(tokens, dim: int):
    """``list<string>`` Arrow array -> the same lists of buckets (``bucket_of``): each
    distinct token of the batch is hashed once."""
    import hashlib

    import pyarrow as pa

    if isinstance(tokens, pa.ChunkedArray):
        tokens = tokens.combine_chunks()
    lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    code = tokens.flatten().dictionary_encode()
    of = np.array([int.from_bytes(hashlib.sha1(t.encode()).digest()[:4], "big") % dim
                   for t in code.dictionary.to_pylist()], np.int32)
    flat = of[code.indices.to_numpy(zero_copy_only=False)] if len(code) else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(flat))


def tokens_embed(tokens, options: EmbedOptions = EmbedOptions()) -> Column:
    """Lower-cased tokens (already cut per chunk) -> embedding column: hashed and counted in
    one Arrow step."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    if options.max_seq_length:
        t = F.slice(t, 1, options.max_seq_length)
    dim, normalize = options.dim, options.normalize

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def _vec(b: "pa.Array") -> "pa.Array":  # noqa: F821
        return _bucket_counts(_token_bucket_ids(b, dim), dim, normalize)

    return _vec(t)


def _bucket_counts(buckets, dim: int, normalize: bool):
    """``list<int>`` Arrow array -> ``list<float>`` Arrow array of (normalised)
    bucket counts, computed for the whole batch with one ``bincount``."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(buckets, pa.ChunkedArray):
        buckets = buckets.combine_chunks()
    n = len(buckets)
    lengths = pc.list_value_length(buckets).fill_null(0).to_numpy(zero_copy_only=False)
    flat = buckets.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    rows = np.repeat(np.arange(n, dtype=np.int64), lengths)
    counts = np.bincount(rows * dim + flat, minlength=n * dim).reshape(n, dim).astype(np.float64)
    if normalize:
        counts /= (np.sqrt((counts * counts).sum(axis=1, keepdims=True)) + EPS)
    values = pa.array(counts.astype(np.float32).ravel(), type=pa.float32())
    return pa.FixedSizeListArray.from_arrays(values, dim).cast(pa.list_(pa.float32()))


def hashed_vector(buckets, dim: int, normalize: bool = True) -> Column:
    """``array<int>`` buckets -> dense ``array<float>`` of counts (normalised).

    An Arrow UDF: the batch arrives as one Arrow list array and leaves as one,
    with no per-row Python objects."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def _vec(b: "pa.Array") -> "pa.Array":  # noqa: F821
        return _bucket_counts(b, dim, normalize)

    return _vec(F.col(buckets) if isinstance(buckets, str) else buckets)


def hash_embed(text, options: EmbedOptions = EmbedOptions()) -> Column:
    """Text column -> embedding column (the default, model-free encoder)."""
    return tokens_embed(tokenize(F.col(text) if isinstance(text, str) else text), options)


def embed(df: DataFrame, text_col: str = "text", out_col: str = "embedding",
          options: EmbedOptions = EmbedOptions()) -> DataFrame:
    return df.withColumn(out_col, hash_embed(text_col, options))


def l2_normalize(v) -> Column:
    """``x / (||x|| + 1e-12)``: zero vectors stay zero."""
    col = F.col(v) if isinstance(v, str) else v
    return scale(col, l2_norm(col) + F.lit(EPS))


def normalize_column(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Normalise a vector column; the norm is computed once per row."""
    return (df.withColumn("_norm", l2_norm(col) + F.lit(EPS))
              .withColumn(col, scale(F.col(col), F.col("_norm")))
              .drop("_norm"))


def embed_with_model(df: DataFrame, model_factory: Callable[[], Callable[[list], np.ndarray]],
                     *, text_col: str = "text", out_col: str = "embedding",
                     options: EmbedOptions = EmbedOptions()) -> DataFrame:
    """Embed with a user model.

    ``model_factory()`` is called once per task and returns ``encode(texts) ->
    float array [n, d]``.  Batches follow ``options.batch_size``; Arrow batch
    size follows ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    out_schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.FloatType()))])
    batch_size = options.batch_size
    normalize = options.normalize

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = model_factory()
        for pdf in batches:
            texts = pdf[text_col].fillna("").tolist()
            parts = [np.asarray(encode(texts[i:i + batch_size]), dtype=np.float32)
                     for i in range(0, len(texts), batch_size)]
            mat = np.vstack(parts) if parts else np.zeros((0, 0), dtype=np.float32)
            if normalize and len(mat):
                mat = (mat / (np.linalg.norm(mat, axis=1, keepdims=True) + EPS)).astype(np.float32)
            yield pdf.assign(**{out_col: list(mat)})

    return df.mapInPandas(run, out_schema)
