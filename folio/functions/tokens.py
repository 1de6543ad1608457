"""Token arrays and token windows, as Column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: a token is a run of letters/digits or one other non-space
# character, taken from the lower-cased text.  ``(?U)``: Unicode white space
# (no-break, thin, ideographic spaces, ...) separates tokens, never becomes one.
TOKEN_PATTERN = r"(?U)[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokenize(col, lower: bool = True) -> Column:
    """Text -> ``array<string>`` of tokens (no special tokens), lower-cased
    unless ``lower=False``."""
    t = F.lower(_c(col)) if lower else _c(col)
    return F.regexp_extract_all(t, F.lit(TOKEN_PATTERN), 0)


def detokenize(tokens) -> Column:
    """Token array back to text: tokens joined by one space."""
    return F.array_join(_c(tokens), " ")


def spans(n, size: int, step: int) -> Column:
    """Windows over ``n`` tokens as ``array<struct<a:int,b:int>>`` (end
    exclusive): starts every ``step`` tokens, stops at the first window that
    reaches the end.  ``n = 0`` gives no window, ``size <= 0`` one window."""
    n = _c(n).cast("int")
    if size <= 0:
        return F.when(n > 0, F.array(F.struct(F.lit(0).alias("a"), n.alias("b")))) \
            .otherwise(F.array().cast("array<struct<a:int,b:int>>"))
    step = max(step, 1)
    last = F.greatest(F.ceil((n - F.lit(size)) / F.lit(step)), F.lit(0)).cast("int")
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct((i * step).alias("a"), F.least(i * step + size, n).alias("b")))
    return F.when(n > 0, windows).otherwise(F.array().cast("array<struct<a:int,b:int>>"))


def window_pieces(tokens, size: int, step: int, per_token=None) -> Column:
    """Windows with their text, built before any explode so that each output
    row carries only its own slice, never the whole token array.

    ``per_token``: optional function token -> value (for example its hash
    bucket); each window then also carries ``aligned``, the values of its own
    tokens.  (Computed per window on purpose: a precomputed per-section
    array referenced once would be inlined by the optimizer into this lambda
    and recomputed for every window.)"""
    toks = _c(tokens)

    def piece(s):
        window = F.slice(toks, s["a"] + 1, s["b"] - s["a"])
        fields = [s["a"].alias("a"), s["b"].alias("b"),
                  F.array_join(window, " ").alias("text")]
        if per_token is not None:
            fields.append(F.transform(window, per_token).alias("aligned"))
        return F.struct(*fields)

    return F.transform(spans(F.size(toks), size, step), piece)


def arrow_tokenizer(fn, lower: bool = False):
    """Wrap a user tokenizer ``str -> list[str]`` as a Column function for
    ``chunk_sections(tokenizer=...)``: an Arrow UDF, called once per Arrow
    batch; the model behind ``fn`` is loaded once per Python worker."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def _tok(texts: pa.Array) -> pa.Array:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        out = []
        for t in texts.to_pylist():
            toks = fn(t or "")
            out.append([x.lower() for x in toks] if lower else list(toks))
        return pa.array(out, type=pa.list_(pa.string()))

    return lambda col: _tok(_c(col))
