"""Corpus operators on vectors, pages and labels, and the pipeline."""

import gzip
import random
import zlib

import numpy as np
import pytest

from folio.llm.lines import line_dedup
from folio.llm.toxicity import Field, chain_messages, score_toxicity, train_toxicity
from folio.llm.vectors import near_vectors
from folio.llm.warc import (page_archive, quarantine_log, read_warc, record_bytes, salvage, write_warc)

SMALL = "/root/testdata/sf0.001"


def vector_truth(rows, cosine=0.98):
    out = []
    good = {}
    for k, (i, label, v) in enumerate(rows):
        ok = (i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)
              and any(v))
        if ok:
            x = np.array(v, float)
            x = x / np.abs(x).max()
            good[k] = x / np.sqrt(x @ x)
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    links = {k: 0 for k in range(len(rows))}
    for a in good:
        for b in good:
            if a < b and rows[a][1] == rows[b][1] and len(good[a]) == len(good[b]) \
                    and good[a] @ good[b] >= cosine:
                links[a] += 1
                links[b] += 1
                x, y = root(rows[a][0]), root(rows[b][0])
                up[max(x, y)] = min(x, y)
    for k, (i, _, _) in enumerate(rows):
        c = root(i) if k in good else i
        out.append((i, links[k], c, None if i is None else i == c))
    return sorted(out, key=str)


@pytest.mark.parametrize("dim", [3, 16, 64])
def test_vectors(spark, dim):
    rng = np.random.default_rng(dim)
    rows = []
    for label in (1, 2, None):
        for _ in range(6):
            center = rng.standard_normal(dim)
            for _ in range(9):
                rows.append((len(rows), label, (center + rng.standard_normal(dim) * 0.1 * rng.random())
                             .tolist()))
    rows += [(len(rows) + k, 1, v) for k, v in enumerate(
        [rows[0][2], rows[0][2], [0.0] * dim, None, [], [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1),
         [None] * dim, (np.array(rows[0][2]) * 1e200).tolist(), (np.array(rows[0][2]) * 1e-200).tolist(),
         rows[0][2] + [0.0]])]
    rows.append((None, 1, rows[0][2]))
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows],
                               "vec_id long, label int, embedding array<double>, point string, size int, "
                               "block int").repartition(3)
    for tile in (256, 20):
        got = sorted(map(tuple, near_vectors(df, tile=tile).collect()), key=str)
        assert got == vector_truth(rows)
    assert near_vectors(df.where("false")).count() == 0


def test_vectors_meet_in_place(spark, monkeypatch):
    """Small blocks, a chain and a group of near copies over several of them, pairs at the limit:
    as all pairs, and nothing is dealt out by a shuffle."""
    from folio.llm import vectors
    rng = np.random.default_rng(5)
    turn = np.arange(40) * np.arccos(0.985)
    group = rng.standard_normal(8) + rng.standard_normal((60, 8)) * 0.01
    rows = [(i, 1, [float(np.cos(t)), float(np.sin(t))]) for i, t in enumerate(rng.permutation(turn))]
    rows += [(100 + i, 2, v.tolist()) for i, v in enumerate(group)]
    rows += [(200, 3, [1.0, 0.0]), (201, 3, [0.98, float(np.sqrt(1 - 0.98 ** 2))]), (202, 3, [0.97999, 0.199])]
    plans = []

    def staged(df, name, real=vectors.stage_table):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name)

    monkeypatch.setattr(vectors, "stage_table", staged)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    assert sorted(map(tuple, near_vectors(df, tile=4, block=7).collect()), key=str) == vector_truth(rows)
    found = dict(plans)["found"]
    assert "CartesianProduct" in found and "Exchange" not in found


def test_repeated_vectors(spark):
    rows = [(5, 1, [1.0, 2.0]), (5, 1, [1.0, 2.0]), (6, 1, [1.0, 2.0])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"))
    assert sorted(map(tuple, got.collect())) == [(5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False)]


PAGES = [(1, "http://a", "<p>é</p>" * 40), (2, "http://b", "<p>é</p>" * 40), (3, None, None), (4, "u", ""),
         (5, "u", "small"), (6, "u\r\nX: y", "small"), (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9),
         (8, "u", "\x1f\r\n\r\nWARC/1.0\r\n" + "y" * 200), (None, "u", "<p>é</p>" * 40),
         (9, "u", "z" * 300_000), (1, "http://a", "<p>é</p>" * 40)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 1, "x") for p in PAGES],
                                 "page_id long, url string, html string, size int, head string")


def test_archive_round_trip(spark, pages):
    import hashlib
    got = sorted(map(tuple, page_archive(pages).collect()), key=str)
    first = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want, seen = [], set()
    for i, _, h in PAGES:
        b = (h or "").encode()
        again = i is not None and len(b) >= 100 and (first[h] != i or (i, h) in seen)
        seen.add((i, h))
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response",
                     first[h] if again else None))
    assert got == sorted(want, key=str)
    assert page_archive(pages.where("false")).count() == 0


def test_archive_repeated_heads(spark, tmp_path):
    """Of rows that repeat the response's page_id, one is the response: the smallest url, null first."""
    x = "x" * 120
    rows = [(1, "b", x), (1, "a", x), (1, "a", x), (2, "a", x), (3, None, x), (None, "a", x), (None, "a", x),
            (4, "a", x + "y"), (4, None, x + "y"), (5, "a", "small"), (5, "a", "small")]
    write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = sorted((r.record_id, r.target_uri, r.record_type, r.refers_to)
                 for r in read_warc(spark, str(tmp_path / "w")).collect())
    page, one, four = "<urn:page:{}>".format, "<urn:page:1>", "<urn:page:4>"
    assert got == sorted([(page(""), "a", "response", None)] * 2 + [
        (one, "a", "response", None), (one, "a", "revisit", one), (one, "b", "revisit", one),
        (page(2), "a", "revisit", one), (page(3), "", "revisit", one),
        (four, "", "response", None), (four, "a", "revisit", four)] + [(page(5), "a", "response", None)] * 2)


def test_salvage_is_linear():
    """Work per record does not grow with the archive: bytes that the decompressor hands back."""
    import folio.llm.warc as warc
    rng = random.Random(3)
    members = [gzip.compress(r, 1) for r in records(50, rng)]
    left, make = [], zlib.decompressobj

    class Counting:
        def __init__(self, bits):
            self.engine = make(bits)

        def decompress(self, piece):
            out = self.engine.decompress(piece)
            left.append(len(self.engine.unused_data))
            return out

        def __getattr__(self, name):
            return getattr(self.engine, name)

    class Zlib:
        error, decompressobj = zlib.error, Counting

    before, warc.zlib = warc.zlib, Zlib
    try:
        assert sum(r.kind == "record" for r in salvage(b"".join(members * 100))) == 5000
    finally:
        warc.zlib = before
    assert len(left) <= 10_100 and max(left) <= warc.FEED


def test_archive_payloads(spark, pages, tmp_path):
    path = str(tmp_path / "warc")
    write_warc(pages, path)
    rows = read_warc(spark, path).collect()
    assert {r.kind for r in rows} == {"record"}
    assert sorted(bytes(r.payload) for r in rows if r.record_type == "response") == \
        sorted((h or "").encode() for k, (i, _, h) in enumerate(PAGES) if i != 2 and not (
            i is not None and len((h or "").encode()) >= 100 and (i, h) in [(a, c) for a, _, c in PAGES[:k]]))
    assert {r.target_uri for r in rows if r.record_id == "<urn:page:6>"} == {"u X: y"}


def records(n, rng):
    import hashlib
    out = []
    for k in range(n):
        body = bytes(rng.randrange(256) for _ in range(rng.randrange(200)))
        out.append(record_bytes(k, f"u{k}", body, hashlib.sha256(body).hexdigest(), None, len(body)))
    return out


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped):
    rng = random.Random(9)
    plain = records(30, rng)
    parts = [gzip.compress(r) if zipped else r for r in plain]
    ids = [f"<urn:page:{k}>" for k in range(30)]

    def read(parts):
        data = b"".join(parts)
        out = list(salvage(data))
        # records and gaps cover the file in order
        at = 0
        for r in out:
            assert r.offset == at
            at += r.length
        assert at == len(data)
        return [r.headers["warc-record-id"] for r in out if r.kind == "record"], \
            [r for r in out if r.kind == "gap"]

    assert read(parts) == (ids, [])
    for k in (0, 7, 29):
        bad = bytearray(parts[k])
        bad[-12] ^= 0x55  # in the block, or the checksum of its member
        got, gaps = read([*parts[:k], bytes(bad), *parts[k + 1:]])
        assert got == ids[:k] + ids[k + 1:] and len(gaps) == 1 and gaps[0].note
        got, gaps = read([*parts[:k], parts[k][:-9], *parts[k + 1:]])  # cut off
        assert [i for i in ids if i not in got] in ([ids[k]], ids[k:k + 1]) and gaps
        got, gaps = read([*parts[:k], b"junk \x1f\x8b\x08 WARC/1.0\r\n", *parts[k:]])
        assert got == ids and len(gaps) == 1
    assert list(salvage(b"")) == []
    assert [r.kind for r in salvage(b"nothing here")] == ["gap"]


def test_salvage_from_files(spark, tmp_path):
    rng = random.Random(1)
    parts = [gzip.compress(r) for r in records(6, rng)]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(b"".join(parts[:3]) + b"???" + b"".join(parts[3:]))
    (folder / "b.warc").write_bytes(b"")
    parsed = read_warc(spark, str(folder))
    assert parsed.where("kind = 'record'").count() == 6
    quarantine_log(parsed, str(tmp_path / "log"))
    gap = spark.read.json(str(tmp_path / "log")).collect()
    assert [(r.offset, r.length) for r in gap] == [(sum(map(len, parts[:3])), 3)]


def test_archive_long_headers(spark, tmp_path):
    rows = [(k, "data:," + "u" * n, f"page {k}") for k, n in enumerate((10, 65_000, 66_000, 100_000, 3_000_000))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id for r in page_archive(pages, str(tmp_path / "w")).collect()} == set(range(5))
    parsed = read_warc(spark, str(tmp_path / "w")).collect()
    assert {r.target_uri for r in parsed} == {u for _, u, _ in rows} and len(parsed) == 5
    plain = b"".join(record_bytes(k, u, b"", "", None, 0) for k, u, _ in rows)
    assert [r.kind for r in salvage(plain)] == ["record"] * 5


def test_messages():
    """Marginals against all paths of short chains."""
    rng = np.random.default_rng(3)
    length = np.array([4, 1, 3])
    first = np.array([0, 4, 5])
    e, t = rng.standard_normal(8), rng.standard_normal((2, 2))
    ahead, back = chain_messages(e, first, length, t)
    for f, n in zip(first, length):
        weight = {}
        for path in np.ndindex(*(2,) * n):
            s = sum(e[f + k] for k in range(n) if path[k]) + sum(t[path[k], path[k + 1]] for k in range(n - 1))
            weight[path] = np.exp(s)
        for k in range(n):
            on = sum(x for p, x in weight.items() if p[k])
            off = sum(x for p, x in weight.items() if not p[k])
            assert abs((ahead + back)[f + k] - np.log(on / off)) < 1e-9


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    field = train_toxicity(docs, labels)
    out = score_toxicity(docs, field).join(labels, "doc_id").collect()
    right = [(r.score >= 0.5) == (r.toxic == 1) for r in out]
    assert len(out) > 300 and np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 for r in out)
    text = {r.doc_id: r.text.encode() for r in docs.collect()}
    spans = [text[r.doc_id][s.start:s.end] for r in out for s in r.spans if r.toxic == 1]
    assert b"idiot" in spans and all(s and s.strip() for s in spans)


def test_toxicity_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (None, "you idiot"), (4, "idiot " * 30000), (5, "x" * 90000),
            (6, "a b"), (6, "a b")]
    docs = spark.createDataFrame([(*r, 7, "y") for r in rows], "doc_id long, text string, toxic int, model string")
    labels = spark.createDataFrame([(6, 1, 0), (6, 1, 1), (1, None, None), (None, 1, 1), (2, 0, 5)],
                                   "doc_id long, quality int, toxic int")
    for lab in (labels, labels.where("false")):
        field = train_toxicity(docs, lab)
        out = score_toxicity(docs, field).collect()
        assert len(out) == len(rows) and all(0 <= r.score < 0.5 for r in out)
    assert score_toxicity(docs.where("false"), Field()).count() == 0
    again = Field.from_bytes(Field().to_bytes())
    assert again.start == Field().start
    kept = score_toxicity(docs, Field(), keep=["doc_id", "toxic", "text"], with_spans=False)
    assert kept.columns == ["doc_id", "toxic", "text", "score"]


def test_pipeline(spark):
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination",
                                         "packing"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    stage = docs
    for name, run in cp.STAGES[:-1]:
        before = {r.doc_id: r.text for r in stage.collect()}
        stage = run(spark, stage, SMALL)
        assert stage.columns == docs.columns and dict(stage.dtypes) == dict(docs.dtypes)
        after = {r.doc_id: r.text for r in stage.collect()}
        assert after.keys() <= before.keys() and stage.count() == len(after)
        if name == "line_dedup":
            want = {r.doc_id: r.text for r in line_dedup(
                spark.createDataFrame([(k, v, f"{k}") for k, v in before.items()],
                                      "doc_id long, text string, source string").drop("source")
                .join(docs.select("doc_id", "source"), "doc_id")).collect()}
            assert after == want
        else:
            assert all(after[k] == before[k] for k in after)
        if name == "near_duplicates":
            assert len(set(after.values()) - {""}) == len([v for v in after.values() if v])
    packed = cp.STAGES[-1][1](spark, stage, SMALL).collect()
    assert {r.doc_id for r in packed} == set(after) <= set(texts)
    assert {tuple(r) for r in cp.run(spark, SMALL).select("doc_id", "piece", "ids_crc32").collect()} == \
        {(r.doc_id, r.piece, r.ids_crc32) for r in packed}


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as cp
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    base = "some words that make a text of more than a few words " * 20
    rows = [(1, base, "en", "s", 1), (2, base, None, None, None), (2, base, None, None, None), (3, None, "x", "s", 0),
            (4, "", "x", "s", 0), (None, base, "x", "s", 0), (5, "other", None, "s", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    for name, run in cp.STAGES[:-1]:
        docs = run(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 1, 3, 4, 5]
    assert {r.doc_id for r in cp.STAGES[-1][1](spark, docs, str(tmp_path)).collect()} == {None, 1, 3, 4, 5}
    for name, run in cp.STAGES:
        assert run(spark, spark.createDataFrame([], schema), str(tmp_path)).count() == 0


def test_pipeline_near_copies(spark):
    """Kept rows against all pairs, at five words and 0.8."""
    import corpus_pipeline as cp
    rng = random.Random(31)
    rows = []
    for n, places in ((100, (30, 70)), (200, (20, 70, 120, 170)), (50, (25,)), (50, (10, 40)), (12, (6,)), (3, ())):
        w = [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
        rows += [" ".join(w), " ".join("x" if k in places else x for k, x in enumerate(w))]
    sets = []
    for t in rows:
        w = t.split(" ")
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root = [root[a] if x == root[b] else x for x in root]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in cp.near_duplicates(spark, docs, SMALL).collect()}
    assert kept == {min(k for k in range(len(rows)) if root[k] == r) for r in root}
    assert not kept & {1, 3, 5}


def test_pipeline_repeated_ids_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline as cp
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    rng = random.Random(6)
    a, b, c = (" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(60)) for _ in range(3))
    near = c.replace(" ", "  ", 3) + " more"
    rows = [(1, a), (2, b), (2, c), (2, near), (3, near), (3, near), (None, a), (4, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 0.5, "x", 7, 8) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, "
                                 "score double, spans string, n_lines int, n_removed int")
    for name, run in cp.STAGES[:-1]:
        docs, before = run(spark, docs, str(tmp_path)), docs
        assert docs.columns == before.columns and dict(docs.dtypes) == dict(before.dtypes)
    got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    one = [t for i, t in got if i == 2 and t != b]
    assert len(one) == 1 and one[0] in (c, near)
    assert got == sorted([(1, a), (2, b), (2, one[0]), (None, a), (4, ""), (4, "")], key=str)


def test_connected_components(spark):
    """Chains, stars and loops dealt over several partitions, against union-find."""
    from folio.llm._util import connected_components
    rng = random.Random(12)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(300, 360)] + [(500, 501), (501, 500), (9, 9)]
    edges += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(150)] + [(None, 3), (4, None)]
    rng.shuffle(edges)
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for parts in (1, 7):
            df = spark.createDataFrame(edges, "a long, b long").repartition(parts)
            got = {(r.node, r.component) for r in connected_components(df).collect()}
            assert got == {(x, root(x)) for x in up}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
