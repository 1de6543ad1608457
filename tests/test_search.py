import numpy as np
import pytest

from folio.config import EmbedOptions, SearchOptions
from folio.operators.embed import hash_embed
from folio.operators.search import (default_query, search, single_request, validate_requests)
from folio.schemas import REQUESTS

DIM = 16
OPTS = EmbedOptions(dim=DIM)


def _chunks(spark):
    texts = {
        "A": ["alpha beta gamma", "beta beta delta", "gamma epsilon", "zeta eta theta",
              "alpha alpha alpha", "iota kappa"],
        "B": ["lambda mu", "mu nu xi", "omicron pi rho"],
    }
    rows = [(f"{t}{i}", t, s, 5, "m", f"u{t}{i}", t, "") for t in texts for i, s in enumerate(texts[t])]
    df = spark.createDataFrame(rows, "chunk_id string, topic string, text string, tokens long, "
                                     "embedding_model string, url string, title string, section string")
    return df.withColumn("embedding", hash_embed("text", OPTS))


def _brute(chunks_pdf, q_vec, topic, k):
    cand = chunks_pdf[chunks_pdf.topic == topic]
    out = []
    for _, r in cand.iterrows():
        a = np.asarray(r.embedding, dtype=np.float64)
        b = np.asarray(q_vec, dtype=np.float64)
        s = float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
        out.append((round(s, 6), r.chunk_id))
    out.sort(key=lambda x: (-x[0], x[1]))
    return [c for _, c in out[:k]]


@pytest.mark.parametrize("method", ["blocks", "pairs", "tiles", "auto_small", "late"])
def test_exact_top_k_equals_brute_force(spark, method):
    chunks = _chunks(spark)
    req = spark.createDataFrame(
        [(1, "A", "alpha gamma", 3), (2, "A", "beta", 2), (3, "B", "mu", 5), (4, " B ", None, 1),
         (5, "C", "nothing here", 3)], REQUESTS)
    # tiny tiles: topic A (6 chunks, 2 requests) becomes 3 x 2 groups
    opts = SearchOptions(tile_chunks=2, tile_queries=1, broadcast_max_rows=2) \
        if method in ("tiles", "auto_small") else SearchOptions()
    m = {"auto_small": "auto", "late": "blocks"}.get(method, method)
    res = search(chunks, req, embed_options=OPTS, method=m, options=opts,
                 late_payload=method == "late").collect()
    cpdf = chunks.toPandas()
    qv = {r.query_id: r.q for r in default_query(validate_requests(req)[0])
          .select("query_id", hash_embed("query", OPTS).alias("q")).collect()}
    for qid, topic, k in ((1, "A", 3), (2, "A", 2), (3, "B", 5), (4, "B", 1)):
        got = [r.chunk_id for r in sorted((r for r in res if r.query_id == qid), key=lambda r: r.rank)]
        assert got == _brute(cpdf, qv[qid], topic, k), qid
    assert not [r for r in res if r.query_id == 5]
    r0 = [r for r in res if r.query_id == 1][0]
    assert r0.source.kind == "wikipedia" and r0.source.url.startswith("uA")


def test_salted_pairs_path_equals_broadcast(spark):
    chunks = _chunks(spark)
    req = spark.createDataFrame([(1, "A", "alpha", 4), (2, "B", "nu", 2)], REQUESTS)
    a = search(chunks, req, embed_options=OPTS, method="pairs").collect()
    b = search(chunks, req, embed_options=OPTS, method="pairs",
               options=SearchOptions(broadcast_max_rows=0, salt=3)).collect()
    key = lambda rows: sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in rows)
    assert key(a) == key(b)


def test_validation_and_default_query(spark):
    req = spark.createDataFrame([(1, "  ", "q", 3), (2, "T", None, 0), (3, " T ", "  ", 2)], REQUESTS)
    valid, rejected = validate_requests(req)
    assert {r.query_id: r.reason for r in rejected.collect()} == {
        1: "topic must be a non-empty string", 2: "k must be positive"}
    row = default_query(valid).first()
    assert (row.topic, row.query) == ("T", "T")


def test_single_request_raises(spark):
    with pytest.raises(ValueError):
        single_request(spark, "  ")
    with pytest.raises(ValueError):
        single_request(spark, "T", k=0)


def test_hash_embedding_unit_norm_and_buckets(spark):
    import hashlib
    df = spark.createDataFrame([("Alpha beta, alpha!",), ("",)], "t string")
    rows = df.select(hash_embed("t", OPTS).alias("v")).collect()
    v = np.asarray(rows[0].v)
    assert abs(np.linalg.norm(v) - 1.0) < 1e-6
    counts = np.zeros(DIM)
    for w in ["alpha", "beta", ",", "alpha", "!"]:
        counts[int(hashlib.sha1(w.encode()).hexdigest()[:8], 16) % DIM] += 1
    np.testing.assert_allclose(v, counts / np.linalg.norm(counts), rtol=1e-6)
    assert not np.any(rows[1].v)


def test_top_k_plan_limits_before_shuffle(spark):
    chunks = _chunks(spark)
    req = spark.createDataFrame([(1, "A", "alpha", 2)], REQUESTS)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = search(chunks, req, embed_options=OPTS, method="pairs")._jdf.queryExecution() \
            .executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # the limit stands on both sides of the exchange
    assert plan.count("WindowGroupLimit") == 2


def test_plan_chunks_never_shuffled_and_chunking_shuffle_free(spark):
    from folio.operators.chunk import chunk_sections
    chunks = _chunks(spark)
    req = spark.createDataFrame([(1, "A", "alpha", 2), (2, "B", "mu", 2)], REQUESTS)
    plan = search(chunks, req, embed_options=OPTS)._jdf.queryExecution().executedPlan().toString()
    # the only exchange is the one moving per-partition candidates to their query
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("MapInPandas") > plan.index("Exchange hashpartitioning")
    secs = spark.createDataFrame([("T", "S", "w " * 500, "u")],
                                 "topic string, title string, text string, url string")
    cplan = chunk_sections(secs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in cplan


def test_score_tiles_exact_with_tiny_tiles(monkeypatch):
    from folio.operators import knn
    rng = np.random.default_rng(11)
    emb = rng.normal(size=(500, 8))
    q = rng.normal(size=(40, 8))
    monkeypatch.setattr(knn, "_TILE_CELLS", 40 * 20)  # 20 chunk rows per tile
    rows, cols, vals = knn._best(emb, q, np.full(40, 3), np.arange(500))
    scores = np.round(emb @ q.T, 6)
    for j in range(40):
        assert set(rows[cols == j]) == set(np.argsort(-scores[:, j], kind="stable")[:3])


def test_tiled_equals_blocks_on_flagship_data(spark):
    from conftest import SF_SMALL
    from folio.plans.queries import _requests, document_chunks
    chunks = document_chunks(spark, SF_SMALL).cache()
    req = _requests(spark, SF_SMALL)
    key = lambda rows: sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in rows)
    blocks = search(chunks, req, method="blocks").collect()
    tiles = search(chunks, req, method="tiles",
                   options=SearchOptions(tile_chunks=7, tile_queries=2)).collect()
    assert key(blocks) == key(tiles) and len(blocks) > 100
    chunks.unpersist()
