from pyspark.sql import functions as F

from folio.config import ChunkOptions, EmbedOptions
from folio.operators.chunk import dropped_pieces
from folio.operators.clean import dropped_sections
from folio.operators.embed import hash_embed
from folio.operators.quiz import parse_block
from folio.operators.search import get_chunks
from folio.operators.sections import lead_first, with_section_urls


def test_drop_counts(spark):
    df = spark.createDataFrame([(1, "short"), (2, "w " * 200)], "id int, text string")
    assert [r.id for r in dropped_sections(df).collect()] == [1]
    # 200 tokens, windows of 62 every 52 tokens: the last piece (tokens 156..199,
    # 44 one-letter tokens = 87 chars) survives; with min_chars 100 it is lost
    lost = dropped_pieces(df.filter("id = 2"), ChunkOptions(max_tokens=64, overlap=10, min_chars=100))
    assert lost.count() == 1


def test_lead_first_and_urls(spark):
    lead = spark.createDataFrame([(1, "  Lead text  ", "u"), (2, "   ", "v")],
                                 "page_id long, text string, page_url string")
    secs = spark.createDataFrame([(1, 0, 1, "History", "body", "u")],
                                 "page_id long, ord int, level int, title string, text string, page_url string")
    out = with_section_urls(lead_first(lead, secs)).orderBy("page_id", "ord").collect()
    assert [(r.page_id, r.ord, r.title, r.text, r.url) for r in out] == [
        (1, -1, None, "Lead text", "u"), (1, 0, "History", "body", "u#History")]


def test_parse_block_single(spark):
    df = spark.createDataFrame([("QUESTION: Why?\nOPTIONS: A) x B) y\nANSWER: B |||",),
                                ("QUESTION: no answer",)], "b string")
    rows = df.select(parse_block(F.col("b")).alias("q")).collect()
    assert rows[0].q.type == "multiple_choice" and dict(rows[0].q.options) == {"A": "x", "B": "y"}
    assert rows[1].q is None


def test_get_chunks_single_call(spark):
    opts = EmbedOptions(dim=32)
    chunks = spark.createDataFrame(
        [(f"c{i}", "T", t, 3, "m", f"u{i}", "T", "") for i, t in
         enumerate(["eigen values", "vector spaces", "eigen vectors and values"])],
        "chunk_id string, topic string, text string, tokens long, embedding_model string, "
        "url string, title string, section string").withColumn("embedding", hash_embed("text", opts))
    hits = get_chunks(spark, chunks, " T ", "eigen values", k=2, embed_options=opts).collect()
    assert [h.rank for h in hits] == [1, 2] and hits[0].chunk_id == "c0"


def test_health_codes_and_precedence(spark):
    from folio.operators.checks import health_check
    req = spark.createDataFrame([(1, "T", 2), (2, "T", 2), (3, "T", 1), (4, "T", 1), (5, "T", 3)],
                                "query_id long, topic string, k int")
    src = "struct<kind:string,url:string,title:string,section:string>"
    hits = spark.createDataFrame(
        [(1, "T", "c1", "text", 0.9, 3, "m", ("w", "u", "t", "")),
         (1, "T", "c2", "text", 0.8, 3, "m", ("w", "u", "t", "")),
         (2, "T", "c1", "text", 0.9, 3, "m", ("w", "u", "t", "")),       # fewer than k
         (3, "T", "c1", "text", 0.9, 3, None, ("w", "u", "t", "")),      # missing field
         (4, "T", "c1", "text", 0.9, 3, "m", ("w", "", "t", "")),        # empty url
         (5, "T", "c1", "", 0.9, 3, None, ("w", "u", "t", ""))],         # short wins
        f"query_id long, topic string, chunk_id string, text string, score double, "
        f"tokens long, embedding_model string, source {src}")
    codes = {r.query_id: r.code for r in health_check(req, hits).collect()}
    assert codes == {1: 0, 2: 2, 3: 3, 4: 4, 5: 2}
    # the first bad hit decides
    two = hits.where("query_id = 1").withColumn("rank", F.when(F.col("chunk_id") == "c1", 1).otherwise(2))
    text_first = two.withColumn("text", F.when(F.col("rank") == 1, "").otherwise("t")).withColumn(
        "tokens", F.when(F.col("rank") == 1, 3))
    field_first = two.withColumn("text", F.when(F.col("rank") == 2, "").otherwise("t")).withColumn(
        "tokens", F.when(F.col("rank") == 2, 3))
    one = req.where("query_id = 1")
    assert health_check(one, text_first).first().code == 4
    assert health_check(one, field_first).first().code == 3


def test_old_references_without_semicolon(spark):
    import html

    from folio.functions.text import unescape_entities
    cases = ["&copy2024 &nbspx &notit; a&ampb", "&notin; &notin &sup2x &sup &zzz; &am &amp;amp", "&lt3 &LTx &Eacutes;",
             "&copy;x &copy=1 &copysr; &ampamp;", "&ordmx&ordfy&not"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r[0] for r in df.select(unescape_entities("t")).collect()]
    assert got == [html.unescape(c) for c in cases]


def test_ingest_actions(spark):
    from folio.operators.checks import ingest_actions
    req = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", False)],
                                "topic string, force boolean")
    idx = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "topic string, indexed boolean")
    got = {r.topic: r.action for r in ingest_actions(req, idx).collect()}
    assert got == {"a": "re-ingest", "b": "ingest", "c": "skip", "d": "ingest"}
