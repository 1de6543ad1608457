from pyspark.sql import functions as F

from folio.operators import store
from folio.schemas import CHUNKS


def _rows(spark, spec, model="m1"):
    return spark.createDataFrame(
        [(cid, topic, f"text {cid}", 3, model, "u", "t", "", 0, [0.0, 1.0]) for cid, topic in spec],
        CHUNKS)


def _ids(df):
    return sorted((r.topic, r.chunk_id, r.embedding_model) for r in df.collect())


def test_merge_replaces_keys_and_is_idempotent(spark):
    existing = _rows(spark, [("a", "T1"), ("b", "T1"), ("a", "T2")])
    new = _rows(spark, [("a", "T1"), ("c", "T1")], model="m2")
    once = store.merge(existing, new)
    assert _ids(once) == [("T1", "a", "m2"), ("T1", "b", "m1"), ("T1", "c", "m2"), ("T2", "a", "m1")]
    assert _ids(store.merge(once, new)) == _ids(once)
    # id-only key: one id replaces rows of every topic
    by_id = store.merge(existing, new, key=("chunk_id",))
    assert _ids(by_id) == [("T1", "a", "m2"), ("T1", "b", "m1"), ("T1", "c", "m2")]
    # empty input is a no-op
    assert _ids(store.merge(existing, new.limit(0))) == _ids(existing)


def test_purge_replace_delete_and_topic_checks(spark):
    existing = _rows(spark, [("a", "T1"), ("b", "T1"), ("c", "T2")])
    topics = spark.createDataFrame([(" T1 ",), ("T3",)], "topic string")
    purged = store.purge_topics(existing, topics)
    assert _ids(purged) == [("T2", "c", "m1")]
    ind = {r.topic: r.indexed for r in store.is_indexed(topics, purged).collect()}
    assert ind == {"T1": False, "T3": False}
    assert {r.topic for r in store.missing_topics(topics, existing).collect()} == {"T3"}
    rep = store.replace_topics(existing, _rows(spark, [("z", "T1")], model="m2"))
    assert _ids(rep) == [("T1", "z", "m2"), ("T2", "c", "m1")]
    ids = spark.createDataFrame([("b",), ("c",)], "chunk_id string")
    assert _ids(store.delete_ids(existing, ids)) == [("T1", "a", "m1")]


def test_counts_capacity_defaults(spark):
    existing = _rows(spark, [("a", "T1"), ("b", "T1"), ("c", "T2")])
    counts = {r.topic: (r.n_chunks, r.n_capped) for r in store.topic_counts(existing, window=2).collect()}
    assert counts == {"T1": (2, 2), "T2": (1, 1)}
    bad = existing.withColumn("title", F.when(F.col("chunk_id") == "a", F.lit("é" * 300)))
    v = {(r.chunk_id, r.column) for r in store.capacity_violations(bad, dim=2).collect()}
    assert v == {("a", "title")}
    v3 = {(r.chunk_id, r.column) for r in store.capacity_violations(existing, dim=3).collect()}
    assert v3 == {("a", "embedding"), ("b", "embedding"), ("c", "embedding")}
    raw = spark.createDataFrame([("x", "T", None, None, None, None, None, None)],
                                "chunk_id string, topic string, tokens long, embedding_model string, "
                                "url string, title string, section string, ingested_at long")
    r = store.apply_defaults(raw, ingested_at=F.lit(5)).first()
    assert (r.tokens, r.embedding_model, r.url, r.title, r.section, r.ingested_at) == (0, "", "", "", "", 5)


def test_chunk_store_versions_and_topic_read(spark, tmp_dir):
    import os
    root = tmp_dir + "/chunks"
    cs = store.ChunkStore(spark, root, buckets=4)
    v1 = cs.write(_rows(spark, [("a", "T1"), ("b", "T2")]))
    v2 = cs.upsert(_rows(spark, [("a", "T1")], model="m2"))
    assert (v1, v2) == (1, 2) and cs.versions() == [1, 2]
    assert _ids(cs.read()) == [("T1", "a", "m2"), ("T2", "b", "m1")]
    assert _ids(cs.read(1)) == [("T1", "a", "m1"), ("T2", "b", "m1")]
    # only T1's bucket was rewritten by version 2
    b1, b2 = cs.bucket_of(["T1"])[0], cs.bucket_of(["T2"])[0]
    assert os.path.isdir(f"{root}/data/version=2/topic_bucket={b1}")
    assert b1 == b2 or not os.path.exists(f"{root}/data/version=2/topic_bucket={b2}")
    t = cs.read_topic("T2")
    assert _ids(t) == [("T2", "b", "m1")]
    both = cs.read_topics(["T1", "T2", "nope"])
    assert _ids(both) == [("T1", "a", "m2"), ("T2", "b", "m1")]
    v3 = cs.purge(spark.createDataFrame([("T1",)], "topic string"))
    assert v3 == 3 and _ids(cs.read()) == [("T2", "b", "m1")]
    v4 = cs.delete(spark.createDataFrame([("b",), ("zz",)], "chunk_id string"))
    assert v4 == 4 and cs.read().count() == 0 and _ids(cs.read(3)) == [("T2", "b", "m1")]
    # a second writer is refused while the lock is held
    open(f"{root}/_lock", "w").close()
    import pytest
    with pytest.raises(Exception, match="locked"):
        cs.upsert(_rows(spark, [("q", "T2")]))
    os.remove(f"{root}/_lock")
    # a crashed write leaves no commit record and stays invisible
    os.makedirs(f"{root}/data/version=5/topic_bucket={b2}")
    assert cs.current_version() == 4 and cs.read().count() == 0
    assert cs.upsert(_rows(spark, [("c", "T2")])) == 5
    assert _ids(cs.read()) == [("T2", "c", "m1")]
    assert cs.vacuum() >= 1 and _ids(cs.read()) == [("T2", "c", "m1")]
    # id-only key: the id's old row in another topic's bucket is replaced too
    cs.upsert(_rows(spark, [("c", "T1")], model="m3"), key=("chunk_id",))
    assert _ids(cs.read()) == [("T1", "c", "m3")]


def test_service_ensure_reingest_purge(spark, tmp_dir):
    from folio.config import ChunkOptions
    from folio.plans.service import Retrieval
    body = " ".join(f"token{i}" for i in range(400))
    html = ('<html lang="en"><head><title>Linear algebra</title></head><body><article>'
            f"<h1>Linear algebra</h1><p>{body}</p><h2>Vector spaces</h2><p>{body} more</p>"
            "<h2>See also</h2><p>" + body + "</p></article></body></html>")
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    cs = store.ChunkStore(spark, tmp_dir + "/svc", buckets=4)
    svc = Retrieval(spark, cs, pages, chunk_options=ChunkOptions(max_tokens=128, overlap=16))
    topics = spark.createDataFrame([("linear algebra",), ("Nope",)], "topic string")
    rejects = {r.topic: r.reason for r in svc.ensure_indexed(topics).collect()}
    assert rejects == {"Nope": "page not found"}
    stored = cs.read().collect()
    assert {r.topic for r in stored} == {"linear algebra"}
    assert {r.title for r in stored} == {"Linear algebra"}
    assert {r.section for r in stored} == {"", "Vector spaces"}
    n = len(stored)
    assert svc.ensure_indexed(topics).count() == 1 and cs.current_version() == 1
    svc.reingest(topics.limit(1), mode="replace")
    assert cs.read().count() == n
    hits = svc.get_chunks_one("linear algebra", "token5 token6", k=3).collect()
    assert [h.rank for h in hits] == [1, 2, 3]
    assert hits[0].source.url.startswith("https://en.wikipedia.org/wiki/Linear_algebra")
    svc.purge(topics)
    assert cs.read().count() == 0


def _scanned(df):
    """Rows that the file scan of a collected plan gave out."""
    plan, found = df._jdf.queryExecution().executedPlan(), []
    df.collect()

    def walk(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if node.nodeName().startswith("Scan"):
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))
    walk(plan)
    return sum(found)


def test_ids_are_found_by_bloom_filters(spark, tmp_dir):
    """Row groups without the ids are not read, for a few ids and for many."""
    import hashlib
    ids = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(4000)]
    cs = store.ChunkStore(spark, tmp_dir + "/chunks", buckets=16)
    cs.write(_rows(spark, [(x, f"T{i % 40}") for i, x in enumerate(ids)]))

    def asked(names):
        return cs.rows_of_ids(spark.createDataFrame([(n,) for n in names], "chunk_id string"))
    none = [hashlib.sha1(f"other{i}".encode()).hexdigest() for i in range(60)]
    for names in (none[:3], none):
        assert asked(names).count() == 0
        assert _scanned(asked(names)) < 1500  # the filters err now and then
    assert {r.chunk_id for r in asked([ids[5], *none[:3]]).collect()} == {ids[5]}
    assert 0 < _scanned(asked([ids[5]])) < 1500
    held = cs.rows_of_ids(spark.createDataFrame([(x,) for x in ids] * 3, "chunk_id string"))  # the semi join
    assert held.select("chunk_id").distinct().count() == 4000
    cs.delete(spark.createDataFrame([(x,) for x in ids[:10]] + [(None,)], "chunk_id string"))
    assert cs.read().count() == 3990


def test_ingest_counts_in_one_pass(spark):
    from folio.operators.chunk import dropped_pieces
    from folio.operators.clean import clean_sections, dropped_sections
    from folio.config import ChunkOptions
    from folio.plans.ingest import IngestCounts, sections_to_chunks
    rows = [("T", "P", f"s{i}", "word " * (7 * i), f"u{i}") for i in range(20)] + [("T", "P", "n", None, None)]
    secs = spark.createDataFrame(rows, "topic string, page_title string, title string, text string, url string")
    options, counts = ChunkOptions(max_tokens=34, overlap=8), IngestCounts()
    kept = sections_to_chunks(secs, options, counts=counts).collect()
    clean = clean_sections(secs)
    lost = dropped_pieces(clean, options).count()
    assert lost > 0 and counts.row() == {
        "sections": 21, "kept_sections": clean.count(), "dropped_sections": 21 - clean.count(),
        "pieces": len(kept) + lost, "chunks": len(kept), "dropped_pieces": lost}
    assert dropped_sections(secs.where("text is not null")).count() == 20 - clean.count()
