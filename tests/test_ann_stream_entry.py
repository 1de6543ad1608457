import os

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from folio.operators.ann import (MAX_CELLS, HashIndex, InvertedFile, build_cells, build_hash_index, cell_counts,
                                 ivf_top_k, lsh_top_k, recall_at_k, train_cells)
from folio.operators.knn import block_top_k
from folio.operators.search import top_k


def _vectors(spark, n=300, dim=8, topics=3, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    rows = [(str(i), str(i % topics), x[i].tolist()) for i in range(n)]
    chunks = spark.createDataFrame(rows, "chunk_id string, topic string, embedding array<float>")
    queries = spark.createDataFrame([(i, str(i % topics), 5, x[i].tolist()) for i in range(0, n, 7)],
                                    "query_id long, topic string, k int, q_embedding array<float>")
    return chunks, queries


def _exact(spark, chunks, queries):
    c = block_top_k(chunks, queries.toPandas()).withColumn("score", F.round("score", 6))
    return top_k(c, 5)


def _brute(chunks, queries):
    cp, qp = chunks.toPandas(), queries.toPandas()
    out = {}
    for _, q in qp.iterrows():
        cand = cp[cp.topic == q.topic]
        m = np.stack(cand.embedding.values).astype(np.float64)
        v = np.asarray(q.q_embedding, dtype=np.float64)
        s = np.round(m @ v / (np.linalg.norm(m, axis=1) * np.linalg.norm(v)), 6)
        order = sorted(zip(-s, cand.chunk_id))[:5]
        out[q.query_id] = [c for _, c in order]
    return out


def test_block_scorer_equals_brute_force(spark):
    chunks, queries = _vectors(spark)
    got = {}
    for r in _exact(spark, chunks, queries).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id))
    assert {k: [c for _, c in sorted(v)] for k, v in got.items()} == _brute(chunks, queries)


def _mean_recall(found, exact):
    return recall_at_k(found, exact).agg(F.avg("recall")).first()[0]


def test_ivf_full_probe_is_exact_and_lsh_recall(spark):
    chunks, queries = _vectors(spark)
    exact = _exact(spark, chunks, queries)
    assert _mean_recall(ivf_top_k(chunks, queries, nlist=4, nprobe=4), exact) == 1.0
    assert 0.0 < _mean_recall(ivf_top_k(chunks, queries, nlist=9, nprobe=2), exact) <= 1.0
    assert _mean_recall(lsh_top_k(chunks, queries, bits=3, probes=8), exact) == 1.0  # all buckets
    assert _mean_recall(lsh_top_k(chunks, queries, bits=4, probes=6), exact) > 0.5


def test_cells_follow_the_square_root():
    assert cell_counts(0) == (1, 1) and cell_counts(10_000) == (10, 10)
    coarse, fine = cell_counts(10 ** 9)
    assert 31_000 < coarse * fine < 33_000
    coarse, fine = cell_counts(10 ** 13)
    assert coarse * fine == MAX_CELLS


def _odd_vectors(spark):
    """Clusters, copies, zero and null vectors, one of another length, null topics."""
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(12, 6))
    rows = []
    for i in range(240):
        v = centers[i % 12] + 0.1 * rng.normal(size=6)
        rows.append((f"c{i}", str(i % 2), v.astype(np.float32).tolist()))
    rows += [(f"d{i}", "0", rows[0][2]) for i in range(7)]  # copies
    rows += [("z1", "0", [0.0] * 6), ("z2", "1", None), ("z3", "1", [0.0] * 6), ("z4", "0", [1.0]), ("n", None, rows[3][2]),
             ("few", "2", rows[5][2]), ("few0", "2", [0.0] * 6)]
    queries = [(i, t, 4, rows[i][2]) for i in range(0, 240, 5) for t in ("0", "1")]
    queries = [(j, t, k, v) for j, (_, t, k, v) in enumerate(queries)]
    queries += [(900, "0", 3, [0.0] * 6), (901, "2", 4, rows[5][2]), (902, "none", 4, rows[5][2]), (903, None, 4, rows[5][2]),
                (904, "1", 130, rows[1][2])]
    return (spark.createDataFrame(rows, "chunk_id string, topic string, embedding array<float>").repartition(3),
            spark.createDataFrame(queries, "query_id long, topic string, k int, q_embedding array<float>"))


def _full(chunks, queries):
    """Rows without a direction have no score and come last."""
    out = {}
    for q in queries.collect():
        qv, scored = np.array(q.q_embedding, float), []
        for c in chunks.where(F.col("topic") == F.lit(q.topic)).collect() if q.topic is not None else ():
            v = np.array(c.embedding or [0.0] * 6, float)
            size = np.linalg.norm(v) * np.linalg.norm(qv)
            ok = len(v) == 6 and size > 0
            scored.append((-round(float(v @ qv / size), 6) if ok else 9.0, c.chunk_id))
        out[q.query_id] = [(None if s == 9.0 else -s, c) for s, c in sorted(scored)[:q.k]]
    return {k: v for k, v in out.items() if v}


def _answers(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.chunk_id))
    return out


def _same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [c for _, c in got[q]] == [c for _, c in want[q]], q
        for (a, _), (b, _) in zip(got[q], want[q]):
            assert a == b or abs(a - b) < 2e-6


def test_bounded_search_is_exact(spark, tmp_dir):
    chunks, queries = _odd_vectors(spark)
    build_cells(chunks, f"{tmp_dir}/ivf", coarse=3, fine=4)
    index = InvertedFile(spark, f"{tmp_dir}/ivf")
    want = _full(chunks, queries)
    _same(_answers(index.exact(queries, 1)), want)
    few = InvertedFile(spark, f"{tmp_dir}/ivf", max_query_rows=5)  # the distributed path: ordinary queries
    plain = queries.where("query_id < 900")
    _same(_answers(few.exact(plain, 1)), {q: want[q] for q in want if q < 900})
    part = index.exact_cost(queries.where("query_id < 900"), 1).first()[0]
    assert 0 < part < 0.5
    assert index.exact(queries.where("false")).count() == 0
    build_cells(chunks.where("false"), f"{tmp_dir}/none")
    assert InvertedFile(spark, f"{tmp_dir}/none").exact(queries).count() == 0


def test_index_rows_are_whole_and_pruned(spark, tmp_dir):
    chunks, queries = _odd_vectors(spark)
    build_cells(chunks, f"{tmp_dir}/ivf", coarse=3, fine=4)
    index = InvertedFile(spark, f"{tmp_dir}/ivf")
    assert sorted(r.chunk_id for r in index.rows.collect()) == sorted(r.chunk_id for r in chunks.collect())
    plan = index._only([0, 1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan
    hits = index.search(queries, 2)
    cell = {r.chunk_id: r.cell for r in index.rows.collect()}
    assert all(cell[r.chunk_id] == r.cell for r in hits.collect())


def test_hash_index_probes_and_copies(spark, tmp_dir):
    chunks, queries = _odd_vectors(spark)
    build_hash_index(chunks, f"{tmp_dir}/h", tables=2, bits=3)
    index = HashIndex(spark, f"{tmp_dir}/h")
    assert index.rows.count() <= 2 * chunks.count()
    plain = queries.where("query_id < 900")
    found = _answers(index.search(plain, 8))  # all buckets: exact
    want = {q: v for q, v in _full(chunks, plain).items()}
    _same(found, want)
    few = HashIndex(spark, f"{tmp_dir}/h", max_query_rows=5)
    _same(_answers(few.search(plain, 8)), want)
    assert 0 < index.search_cost(plain, 2).first()[0] < 2


def test_stream_ingest_equals_batch(spark):
    from folio.plans.queries import document_chunks
    from folio.streaming.ingest import run_ingest
    sink = run_ingest(spark, f"{SF_SMALL}/documents*.parquet")
    streamed = spark.read.parquet(sink).select("chunk_id", "text").collect()
    from folio.config import INGEST_CHUNKS
    batch = document_chunks(spark, SF_SMALL, INGEST_CHUNKS).select("chunk_id", "text").collect()
    assert sorted(streamed) == sorted(batch) and len(batch) > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"query_id", "rank", "chunk_id", "score", "source_url"}
    qs, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(qs)
    missing = set(qs) - set(sql) - set(e.LLM_QUERIES)
    assert not missing
    assert os.path.isdir(SF_SMALL)


def test_ann_tiled_path_equals_broadcast_path(spark):
    chunks, queries = _vectors(spark)
    key = lambda rows: sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in rows)
    model = train_cells(chunks, coarse=2, fine=2)
    small = ivf_top_k(chunks, queries, nprobe=2, model=model).collect()
    tiled = ivf_top_k(chunks, queries, nprobe=2, model=model, max_query_rows=3).collect()
    assert key(small) == key(tiled) and len(small) > 0
    l1 = lsh_top_k(chunks, queries, bits=4, probes=4).collect()
    l2 = lsh_top_k(chunks, queries, bits=4, probes=4, max_query_rows=3).collect()
    assert key(l1) == key(l2)


def test_stream_skips_already_stored_topics(spark):
    from folio.streaming.ingest import run_ingest
    stored = spark.createDataFrame([("src0",), ("src1",)], "topic string")
    sink = run_ingest(spark, f"{SF_SMALL}/documents*.parquet", skip_topics=stored)
    topics = {r.topic for r in spark.read.parquet(sink).select("topic").distinct().collect()}
    assert topics and not topics & {"src0", "src1"}


def test_block_scorer_many_topics_semi_join(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2400, 4)).astype(np.float32)
    rows = [(str(i), f"t{i % 1200}", x[i].tolist()) for i in range(2400)]
    chunks = spark.createDataFrame(rows, "chunk_id string, topic string, embedding array<float>")
    queries = spark.createDataFrame([(i, f"t{i}", 1, x[i].tolist()) for i in range(1100)],
                                    "query_id long, topic string, k int, q_embedding array<float>")
    got = {r.query_id: r.chunk_id for r in _exact(spark, chunks, queries).collect()}
    assert len(got) == 1100 and all(got[i] == str(i) for i in range(1100))


def test_entry_without_the_corpus_operators(tmp_path):
    """The other queries stay when the optional parts are not there."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parent.parent
    shutil.copytree(root / "folio", tmp_path / "folio", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = ("import __spark_entry__ as e; assert len(e.queries()) > 30 and 'retrieve' in e.oracle_sql(); "
            "assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries())")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_costs_of_a_query_set_beyond_the_bound(spark, tmp_dir):
    from folio.operators.ann import build_cells, build_hash_index
    chunks, queries = _vectors(spark)
    build_cells(chunks, f"{tmp_dir}/ivf", coarse=2, fine=2)
    build_hash_index(chunks, f"{tmp_dir}/h", bits=4)
    part = lambda df: round(df.first().scored_fraction, 9)
    for few, many in ((InvertedFile(spark, f"{tmp_dir}/ivf", max_query_rows=3), InvertedFile(spark, f"{tmp_dir}/ivf")),
                      (HashIndex(spark, f"{tmp_dir}/h", max_query_rows=3), HashIndex(spark, f"{tmp_dir}/h"))):
        args = (queries, 2) if isinstance(few, InvertedFile) else (queries,)
        assert part(few.search_cost(*args)) == part(many.search_cost(*args))
    few, many = InvertedFile(spark, f"{tmp_dir}/ivf", max_query_rows=3), InvertedFile(spark, f"{tmp_dir}/ivf")
    assert part(few.exact_cost(queries)) == part(many.exact_cost(queries))
    plan = few.exact(queries)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan  # a query is not copied for each cell


def test_leaves_in_reach_share_one_product(monkeypatch):
    """Many small leaves of a cell are scored together, and the best rows are those of all pairs."""
    import pandas as pd
    import pyarrow as pa
    from folio.operators import ann
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    heads = unit(rng.normal(size=(30, 4)))
    rows = unit(np.repeat(heads, 3, axis=0) + rng.normal(size=(90, 4)) * 0.05)
    rows[::3] = heads
    asks = unit(rng.normal(size=(5, 4))).astype(np.float32)
    asked = ann._Queries(pd.DataFrame({"query_id": range(5), "topic": ["t"] * 5, "k": [3] * 5, "q_embedding": list(asks)}), 4)
    scores = np.round(unit(rows.astype(np.float32).astype(float)) @ unit(asks.astype(float)).T, 6)
    asked.kth = np.sort(scores, axis=0)[-3]
    visits = ann._Bounds(asked, np.array([0]), np.eye(4)[:1], np.array([np.pi]), 0.6)
    batch = pa.record_batch([pa.array([f"{i:02}" for i in range(90)]), pa.array(["t"] * 90), pa.array([0] * 90),
                             pa.array(rows.astype(np.float32).tolist(), pa.list_(pa.float32())),
                             pa.array(np.repeat(range(30), 3)), pa.array([i % 3 == 0 for i in range(90)])],
                            ["chunk_id", "topic", "cell", "embedding", "leaf", "leads"])
    calls, real = [], ann._Scan._score
    monkeypatch.setattr(ann._Scan, "_score", lambda self, *a: calls.append(1) or real(self, *a))
    scan = ann._Scan(asked, visits, "cell")
    scan.add(ann._Rows(batch, 4))
    assert len(calls) <= 2
    got = {}
    for r in scan.result().to_pylist():
        got.setdefault(r["query_id"], set()).add((r["chunk_id"], round(r["score"], 6)))
    for q in range(5):
        best = sorted(range(90), key=lambda i: (-scores[i, q], i))[:3]
        assert {c for c, _ in got[q]} == {f"{i:02}" for i in best}
    cost = ann._Scan(asked, visits, "cell", count=True)
    cost.add(ann._Rows(batch, 4))
    near = ann._Bounds.reach(scores[::3].T, 0.6, asked.kth[:, None])
    assert abs(cost.scored - int((5 - near.sum(0)).sum() + 3 * near.sum())) <= 3  # rounded scores at the bound
