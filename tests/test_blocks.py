import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.config import EmbedOptions, SearchOptions
from folio.operators import blocks, knn
from folio.operators.embed import hash_embed
from folio.operators.search import search
from folio.schemas import REQUESTS

OPTS = EmbedOptions(dim=16)
CHUNKS = ("chunk_id string, topic string, text string, tokens long, embedding_model string, url string, "
          "title string, section string")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _chunks(spark):
    words = ["alpha", "beta", "gamma", "delta", "mu"]
    rows = [(f"c{i:03}", None if i == 7 else "AAAB"[i % 4], "" if i == 9 else " ".join(words[(i * j) % 5] for j in range(1, 5)),
             4, "m", f"u{i}", "t", "") for i in range(60)]
    return spark.createDataFrame(rows, CHUNKS).withColumn("embedding", hash_embed("text", OPTS))


def _requests(spark):
    rows = [(i, "AAB"[i % 3], ["alpha beta", "mu", "delta delta gamma"][i % 3], 2 + i % 4) for i in range(20)]
    return spark.createDataFrame([*rows, (20, "zz", "mu", 3)], REQUESTS)


def test_product_of_blocks_copies_nothing_and_equals_pairs(spark):
    chunks, asked = _chunks(spark), _requests(spark)
    opts = SearchOptions(tile_chunks=7, tile_queries=3)
    got = search(chunks, asked, embed_options=OPTS, method="tiles", options=opts)
    assert "CoGroup" not in _plan(got)
    vectors = asked.where("query is not null").withColumn("q_embedding", hash_embed("query", OPTS))
    plan = _plan(knn.tiled_top_k(chunks.select("chunk_id", "topic", "embedding"), vectors, tile_chunks=7, tile_queries=3))
    assert "CartesianProduct" in plan and "Exchange" not in plan  # no copies by a shuffle
    key = lambda df: sorted((r.query_id, r.rank, r.chunk_id, r.score, r.text) for r in df.collect())
    assert key(got) == key(search(chunks, asked, embed_options=OPTS, method="pairs"))


def test_rows_packed_once(spark):
    rows = _chunks(spark)
    packed = blocks.pack(rows.sortWithinPartitions("topic"), "topic", "embedding", "test", 7)
    found = [r for b in packed.collect() for r in knn.pa.ipc.open_stream(bytes(b.block)).read_all().to_pylist()]
    assert sorted(r["chunk_id"] for r in found) == sorted(r.chunk_id for r in rows.where("topic is not null").collect())
    assert blocks.longest(packed) == 16 and packed.count() > 1


@pytest.mark.parametrize("metric", ["cosine", "ip"])
def test_single_precision_loses_nothing(spark, metric):
    """Scores that differ by less than single precision shows, ties, and vectors without a direction."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(40, 8)), 10, axis=0) * 100 + rng.normal(size=(400, 8)) * 1e-5
    x[::50] = 0
    rows = [(f"{i:03}", "t", v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    chunks = spark.createDataFrame(rows, "chunk_id string, topic string, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(i, "t", 5, x[i].astype(np.float32).tolist()) for i in range(30)],
                                  "query_id long, topic string, k int, q_embedding array<float>")
    def top(cands):
        out = {}
        for r in cands.collect():
            out.setdefault(r.query_id, []).append((-np.inf if r.score is None else r.score, r.chunk_id))
        return {q: sorted(v, key=lambda p: (-round(p[0], 6) if np.isfinite(p[0]) else np.inf, p[1]))[:5] for q, v in out.items()}
    tiled = top(knn.tiled_top_k(chunks, asked, metric=metric, tile_chunks=30, tile_queries=7))
    whole = top(knn.block_top_k(chunks, asked.toPandas(), metric=metric))
    assert {q: [c for _, c in v] for q, v in tiled.items()} == {q: [c for _, c in v] for q, v in whole.items()}


def test_many_requests_of_few_stored_topics_are_few(spark):
    """Requests of topics without chunks do not bring on the product of all with all."""
    chunks, asked = _chunks(spark), _requests(spark)
    many = asked.unionByName(spark.range(100, 140).select(
        F.col("id").alias("query_id"), F.concat(F.lit("none"), "id").alias("topic"), F.lit("q").alias("query"), F.lit(2).alias("k")))
    got = search(chunks, many, embed_options=OPTS, options=SearchOptions(broadcast_max_rows=25))
    assert "CoGroup" not in _plan(got) and "CartesianProduct" not in _plan(got)
    key = lambda df: sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in df.collect())
    assert key(got) == key(search(chunks, asked, embed_options=OPTS, method="pairs"))


def test_ingest_report_chunks_documents_once(spark):
    """The store is written first; the report reads it, whatever asks of it."""
    from conftest import SF_SMALL
    from folio.plans.queries import q_ingest_report
    got = q_ingest_report(spark, SF_SMALL)
    assert "ArrowEvalPython" not in _plan(got)  # the embedding of chunks
    assert got.where("n_chunks > 0 and rank is null").count() == 0 and got.count() > 0


def test_product_runs_once_whatever_reads_the_hits(spark):
    """Lessons read the hits several times; the product's hits are written, its blocks are gone."""
    chunks, asked = _chunks(spark), _requests(spark)
    got = search(chunks, asked, embed_options=OPTS, method="tiles", options=SearchOptions(tile_chunks=7, tile_queries=3))
    assert "CartesianProduct" not in _plan(got) and "MapInArrow" not in _plan(got)
    key = lambda df: sorted((r.query_id, r.rank, r.chunk_id, r.score, r.text) for r in df.collect())
    assert key(got) == key(got) == key(search(chunks, asked, embed_options=OPTS, method="pairs"))


def test_many_requests_are_counted_not_embedded(spark, monkeypatch):
    opts = SearchOptions(broadcast_max_rows=5, tile_chunks=7)
    asked = _requests(spark).where("topic <> 'zz'")
    real = []

    def bounded(df, n):
        real.append(_plan(df))
        return None

    monkeypatch.setattr(knn, "collect_bounded", bounded)
    search(_chunks(spark), asked, embed_options=OPTS, options=opts)
    assert len(real) == 1 and "ArrowEvalPython" not in real[0]  # the written requests only


def test_tokens_hashed_in_batches_are_those_of_sql(spark):
    from folio.operators.embed import buckets_embed, hash_embed, token_buckets
    rows = [(i, t) for i, t in enumerate(["Alpha beta, ALPHA", "", None, "\u00c9t\u00e9 \u4e2d\u6587 x", "a " * 500])]
    df = spark.createDataFrame(rows, "i int, text string").coalesce(1)
    for opts in (OPTS, EmbedOptions(dim=7, max_seq_length=3), EmbedOptions(dim=5, normalize=False)):
        got = df.select(hash_embed("text", opts).alias("a"),
                        buckets_embed(token_buckets("text", opts.dim), opts).alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got]


def test_lessons_sort_moves_what_is_asked_for(spark, tmp_dir):
    from folio.operators.lessons import read_lessons
    rows = spark.createDataFrame([(f"t{i}", "x" * 50, i) for i in range(9)], "topic string, lesson string, n int")
    rows.select("topic", "lesson", F.timestamp_seconds("n").alias("created_at")).write.parquet(f"{tmp_dir}/lessons")
    got = read_lessons(spark, f"{tmp_dir}/lessons", "topic", F.md5("lesson").alias("h"))
    plan = _plan(got)
    assert "md5" in plan[plan.index("Exchange"):]  # below the sort
    assert [r.topic for r in got.collect()] == [r.topic for r in read_lessons(spark, f"{tmp_dir}/lessons").collect()]
