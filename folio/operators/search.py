"""Topic-scoped similarity search over a chunk table.

Batch first: a ``requests(query_id, topic, query, k)`` table is answered in
one plan.  A single call is a one-row request table.

Exact top-k plan::

    requests -> validate -> default query -> embed       (small side)
    chunks   -> prune to needed columns, norm once       (big side, no shuffle)
    join on topic (broadcast when the request side is proven small,
                   else a salted shuffle join so a hot topic spreads over
                   ``salt`` partitions)
    score -> row_number per query_id, bounded by a literal k_max so Spark
    keeps only k_max rows per query per partition *before* the shuffle
    -> filter rank <= k -> result shape with the citation struct
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..config import EmbedOptions, SearchOptions
from ..functions.text import py_strip
from ..functions.vectors import cosine, dot, l2_norm
from .embed import hash_embed


class RetrievalError(Exception):
    """Raised for a failing single-request call."""


# ---------------------------------------------------------------------------
# Requests
# ---------------------------------------------------------------------------
def validate_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split requests into (valid, rejected).  Topic is stripped; an empty
    topic or a non-positive k is rejected with its reason."""
    staged = requests.withColumn("topic", py_strip(F.coalesce(F.col("topic"), F.lit(""))))
    reason = (F.when(F.col("topic") == "", F.lit("topic must be a non-empty string"))
               .when(F.col("k").isNull() | (F.col("k") <= 0), F.lit("k must be positive")))
    staged = staged.withColumn("reason", reason)
    valid = staged.filter(F.col("reason").isNull()).drop("reason")
    rejected = staged.filter(F.col("reason").isNotNull())
    return valid, rejected


def default_query(requests: DataFrame) -> DataFrame:
    """Blank or null query -> the topic string."""
    q = py_strip(F.coalesce(F.col("query"), F.lit("")))
    return requests.withColumn("query", F.when(q != "", q).otherwise(F.col("topic")))


def embed_requests(requests: DataFrame, options: EmbedOptions = EmbedOptions()) -> DataFrame:
    return requests.withColumn("q_embedding", hash_embed(F.col("query"), options))


def single_request(spark, topic: str, query: str | None = None, k: int = 6) -> DataFrame:
    """One call as a one-row request table; a request that the batch check
    rejects raises its reason."""
    from ..schemas import REQUESTS
    valid, rejected = validate_requests(spark.createDataFrame([(0, topic, query, k)], REQUESTS))
    bad = rejected.first()
    if bad is not None:
        raise ValueError(bad["reason"])
    return valid


# ---------------------------------------------------------------------------
# Scoring and top-k
# ---------------------------------------------------------------------------
def _max_k(requests: DataFrame, options: SearchOptions) -> int:
    """The literal rank bound.  One tiny aggregate; falls back to the option."""
    row = requests.agg(F.max("k").alias("m")).first()
    m = row["m"] if row is not None and row["m"] is not None else options.k_max
    return int(max(m, 1))


def _request_rows(requests: DataFrame) -> int:
    return requests.count()


def score_pairs(chunks: DataFrame, requests: DataFrame, *, metric: str = "cosine",
                options: SearchOptions = SearchOptions(), request_rows: int | None = None,
                chunk_vec: str = "embedding", query_vec: str = "q_embedding",
                keys: tuple = ("topic",)) -> DataFrame:
    """Join requests to the chunks of their topic and score every pair.

    ``requests`` must carry ``query_id, k, <keys>, q_embedding``.
    """
    keys = list(keys)
    c = chunks.withColumn("_c_norm", l2_norm(chunk_vec)) if metric == "cosine" else chunks
    r = requests.withColumn("_q_norm", l2_norm(query_vec)) if metric == "cosine" else requests
    rows = request_rows if request_rows is not None else _request_rows(requests)
    if rows <= options.broadcast_max_rows:
        joined = c.join(F.broadcast(r), on=keys, how="inner")
    else:
        # salted shuffle join: a topic holding a third of the chunks is split
        # over `salt` partitions; each request is repeated `salt` times.
        c = c.withColumn("_salt", F.pmod(F.xxhash64("chunk_id"), F.lit(options.salt)).cast("int"))
        r = r.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(options.salt - 1))))
        joined = c.join(r, on=keys + ["_salt"], how="inner").drop("_salt")
    if metric == "cosine":
        score = cosine(chunk_vec, query_vec, "_c_norm", "_q_norm")
    elif metric in ("ip", "dot"):
        score = dot(chunk_vec, query_vec)
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return (joined.withColumn("score", F.round(score, options.score_decimals))
                  .drop("_c_norm", "_q_norm", chunk_vec, query_vec))


def top_k(scored: DataFrame, k_bound: int, *, part: str = "query_id",
          order_id: str = "chunk_id") -> DataFrame:
    """Keep the best ``k`` rows per ``part`` (ties: lower id first).

    The literal ``rank <= k_bound`` lets Spark insert a partial per-partition
    limit before the shuffle on ``part``; ``rank <= k`` then applies the
    per-row k.
    """
    w = Window.partitionBy(part).orderBy(F.col("score").desc_nulls_last(), F.col(order_id))
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked.filter((F.col("rank") <= F.lit(k_bound)) & (F.col("rank") <= F.col("k")))


def shape_results(hits: DataFrame, kind: str = config.SOURCE_KIND) -> DataFrame:
    """Result rows with the nested citation ``source`` struct."""
    return hits.select(
        "query_id", F.col("rank").cast("int").alias("rank"), "topic", "chunk_id", "text",
        F.col("score").cast("double").alias("score"),
        F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens"),
        "embedding_model",
        F.struct(F.lit(kind).alias("kind"), F.col("url").alias("url"),
                 F.col("title").alias("title"), F.col("section").alias("section")).alias("source"))


PAYLOAD = ("text", "tokens", "embedding_model", "url", "title", "section")


def search(chunks: DataFrame, requests: DataFrame, *,
           embed_options: EmbedOptions = EmbedOptions(),
           options: SearchOptions = SearchOptions(), metric: str = "cosine",
           model_filter: bool = False, method: str = "auto",
           late_payload: bool = False) -> DataFrame:
    """Exact batch top-k.  Rejected requests are dropped here; use
    ``validate_requests`` to see them.

    ``method``: ``"blocks"`` broadcasts the (size-checked) request side and
    scores chunk partitions by matrix products (``operators.knn``);
    ``"tiles"`` is the fully distributed block product for request sets of
    any size; ``"pairs"`` joins and scores pair rows in SQL (reference
    path); ``"auto"`` and ``"blocks"`` use blocks when at most
    ``options.broadcast_max_rows`` requests exist, tiles above.  All give the
    same answer: a chunk or request without a direction (zero vector) has a null
    score and ranks last.
    """
    valid, _ = validate_requests(requests)
    prepared = embed_requests(default_query(valid), embed_options).select(
        "query_id", "topic", "k", "q_embedding")
    needed = chunks.select("chunk_id", "topic", "embedding", *PAYLOAD)
    if model_filter:
        needed = needed.filter(F.col("embedding_model") == embed_options.model_name)
    if method == "pairs":
        rows = _request_rows(valid)
        k_bound = _max_k(valid, options)
        scored = score_pairs(needed, prepared, metric=metric, options=options, request_rows=rows)
        return shape_results(top_k(scored, k_bound))
    from ..session import write_shared
    from .knn import block_top_k, collect_bounded
    # one bounded pass: at most broadcast_max_rows request rows reach the driver; more than
    # that, counted before any is embedded, switches to the tiled (fully distributed) path
    req_pdf = None
    if method in ("auto", "blocks") and valid.limit(options.broadcast_max_rows + 1).count() <= options.broadcast_max_rows:
        req_pdf = collect_bounded(prepared, options.broadcast_max_rows)
    if req_pdf is None:
        # written once and numbered; requests of topics without chunks have no hits, and
        # the others may be few
        needed = write_shared(needed.withColumn("_row", F.monotonically_increasing_id()), "searched")
        prepared = write_shared(prepared.join(needed.select("topic").distinct(), "topic", "left_semi"), "requests")
        if method != "tiles":
            req_pdf = collect_bounded(prepared, options.broadcast_max_rows)
    if req_pdf is None:
        return _search_tiled(needed, prepared, options, metric)
    scored_cols = needed.select("chunk_id", "topic", "embedding") if late_payload else needed
    payload = () if late_payload else PAYLOAD
    k_bound = int(req_pdf["k"].max()) if len(req_pdf) else 1
    cands = block_top_k(scored_cols, req_pdf, metric=metric, payload=payload)
    cands = cands.withColumn("score", F.round("score", options.score_decimals))
    hits = top_k(cands, k_bound)
    if late_payload:
        hits = hits.select("query_id", "k", "chunk_id", "topic", "score", "rank")
        # at most the sum of the requests' own k rows of ids
        if int(req_pdf["k"].sum()) <= options.broadcast_max_hits:
            hits = F.broadcast(hits)
        rows = needed.select("chunk_id", "topic", *PAYLOAD)
        hits = rows.join(hits, ["chunk_id", "topic"])
    return shape_results(hits)


def _search_tiled(rows: DataFrame, asked: DataFrame, options: SearchOptions, metric: str) -> DataFrame:
    """``search`` for request sets of any size: the product of blocks moves vectors, ids and
    row numbers, and the payload joins the final hits.  The hits are written without it, so
    the product runs once whatever reads them, and the blocks are deleted."""
    from ..session import drop_shared, write_shared
    from .knn import tiled_top_k
    cands = tiled_top_k(rows.select("chunk_id", "topic", "embedding", "_row"), asked, metric=metric,
                        payload=("_row",), tile_chunks=options.tile_chunks, tile_queries=options.tile_queries)
    blocks = cands._blocks
    hits = write_shared(top_k(cands.withColumn("score", F.round("score", options.score_decimals)),
                              _max_k(asked, options)).select("query_id", "score", "rank", "_row"), "hits")
    for done in (*blocks, asked):
        drop_shared(done)
    return shape_results(hits.join(rows.select("_row", "chunk_id", "topic", *PAYLOAD), "_row"))


def get_chunks(spark, chunks: DataFrame, topic: str, query: str | None = None, k: int = 6,
               **kw) -> DataFrame:
    """Single call: a one-row batch.  Ordered by rank."""
    return search(chunks, single_request(spark, topic, query, k), **kw).orderBy("rank")
