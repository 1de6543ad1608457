"""Registered queries: each takes (spark, base_dir) and returns a DataFrame.

They read the given tables (or data Spark derives from them) whole.  Column
names match the SQL in ``plans.oracle``.  Where a table lacks the case an
operator exists for (citation markers, nested headings, quiz text), the
input is derived from every row by a fixed rule that the SQL repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from ..config import INGEST_CHUNKS, ChunkOptions, EmbedOptions
from ..functions.text import preview, unescape_entities
from ..functions.vectors import cosine
from ..operators import checks, lessons, quiz, store
from ..operators.chunk import chunk_sections
from ..operators.clean import clean_sections
from ..operators.search import embed_requests, search, validate_requests
from ..operators.sections import prune_boilerplate
from ..sources.pages import lookup_pages, page_sections, scan_pages
from ..sources.tables import document_requests, document_sections, read_table, spread
from ..streaming import topics
from .ingest import PLACE, IngestCounts, first_sections, sections_to_chunks

FLAGSHIP_CHUNKS = ChunkOptions(max_tokens=256, overlap=32)
EMBED = EmbedOptions()


SPREAD_PER_SLOT = 1


def _docs(spark, base) -> DataFrame:
    return spread(read_table(spark, base, "documents"), "doc_id", SPREAD_PER_SLOT)


def document_chunks(spark: SparkSession, base: str, chunk_options: ChunkOptions = FLAGSHIP_CHUNKS,
                    embed_options: EmbedOptions = EMBED) -> DataFrame:
    """Store rows built from ``documents`` (ingest time fixed at 0 so results
    are repeatable)."""
    return sections_to_chunks(document_sections(_docs(spark, base)), chunk_options, embed_options,
                              ingested_at=F.lit(0))


def flatten_source(results: DataFrame) -> DataFrame:
    return results.select(
        "query_id", "rank", "topic", "chunk_id", "text", "score", "tokens", "embedding_model",
        F.col("source.kind").alias("source_kind"), F.col("source.url").alias("source_url"),
        F.col("source.title").alias("source_title"),
        F.col("source.section").alias("source_section"))


def _requests(spark, base) -> DataFrame:
    return document_requests(_docs(spark, base))


def _results(spark, base) -> DataFrame:
    return search(document_chunks(spark, base), _requests(spark, base))


# ---------------------------------------------------------------------------
# Retrieval
# ---------------------------------------------------------------------------
def q_retrieve(spark: SparkSession, base: str) -> DataFrame:
    """Flagship: documents -> clean -> chunk 256/32 -> hash-embed 384 ->
    curated requests -> exact batch top-k -> cited results."""
    return flatten_source(_results(spark, base))


def _vectors(spark, base):
    emb = spread(read_table(spark, base, "embeddings"), "vec_id")
    chunks = emb.select(F.col("vec_id").cast("string").alias("chunk_id"),
                        F.col("label").cast("string").alias("topic"), "embedding",
                        *[F.lit("").alias(c) for c in ("text", "embedding_model", "url", "title",
                                                       "section")],
                        F.lit(0).cast("long").alias("tokens"))
    queries = emb.select(F.col("vec_id").alias("query_id"),
                         F.col("label").cast("string").alias("topic"),
                         F.lit(4).alias("k"), F.col("embedding").alias("q_embedding"))
    return chunks, queries


def _vector_top_k(spark, base, metric: str) -> DataFrame:
    from ..config import SearchOptions
    from ..operators.knn import block_top_k, collect_bounded, tiled_top_k
    from ..operators.search import top_k
    chunks, queries = _vectors(spark, base)
    qpdf = collect_bounded(queries, SearchOptions().broadcast_max_rows)
    if qpdf is not None:
        cands = block_top_k(chunks, qpdf, metric=metric)
    else:
        cands = tiled_top_k(chunks, queries, metric=metric)
    cands = cands.withColumn("score", F.round("score", 6))
    return top_k(cands, 4).select("query_id", F.col("rank").cast("int").alias("rank"),
                                  "topic", "chunk_id", "score")


def q_topk_vectors(spark, base):
    """Every stored vector asks for its 4 nearest (cosine) within its label."""
    return _vector_top_k(spark, base, "cosine")


def q_topk_vectors_ip(spark, base):
    """The same with the inner product."""
    return _vector_top_k(spark, base, "ip")


def q_query_embed(spark, base):
    """Request validation + default query + query embedding (per request:
    non-zero buckets and a position-weighted checksum)."""
    docs = read_table(spark, base, "documents")
    req = docs.select(
        F.col("doc_id").alias("query_id"),
        F.when(F.pmod("doc_id", F.lit(10)) == 0, F.lit("  ")).otherwise(F.col("source")).alias("topic"),
        F.when(F.pmod("doc_id", F.lit(4)) == 0, F.lit(None).cast("string"))
         .when(F.pmod("doc_id", F.lit(4)) == 1, F.lit(" \n ")).otherwise(F.col("text")).alias("query"),
        (F.pmod("doc_id", F.lit(7)) - 1).cast("int").alias("k"))
    valid, rejected = validate_requests(req)
    from ..operators.search import default_query
    emb = embed_requests(default_query(valid), EMBED)
    ok = emb.select("query_id", "topic", "k", F.lit(None).cast("string").alias("reason"),
                    *_vec_summary("q_embedding"))
    bad = rejected.select("query_id", "topic", "k", "reason",
                          *[F.lit(None).cast(t).alias(n) for n, t in
                            (("nnz", "int"), ("vsum", "double"), ("vpos", "double"))])
    return ok.unionByName(bad)


def _vec_summary(col):
    nnz = F.size(F.filter(col, lambda x: x > 0)).alias("nnz")
    vsum = F.round(F.aggregate(col, F.lit(0.0).cast("double"),
                               lambda a, x: a + x.cast("double")), 5).alias("vsum")
    vpos = F.round(F.aggregate(F.transform(col, lambda x, i: x.cast("double") * i),
                               F.lit(0.0).cast("double"), lambda a, x: a + x), 3).alias("vpos")
    return [nnz, vsum, vpos]


# ---------------------------------------------------------------------------
# Cleaning, chunking, embedding
# ---------------------------------------------------------------------------
def marked_documents(spark, base) -> DataFrame:
    """Documents with citation markers, space/tab/no-break-space runs, a
    newline run and outer whitespace injected from each row."""
    docs = _docs(spark, base)
    marker = F.concat(F.lit(".  ["), F.pmod("doc_id", F.lit(50)).cast("string"), F.lit("]  "))
    text = F.concat(F.lit(" \t"), F.replace("text", F.lit(". "), marker),
                    F.lit("\n\n\n\n[Citation needed]\t  end [7]. "))
    return docs.withColumn("text", text)


def q_clean_chunk(spark, base):
    """Clean (markers injected) -> short-section filter -> 256/32 chunks."""
    secs = clean_sections(document_sections(marked_documents(spark, base)))
    ch = chunk_sections(secs, FLAGSHIP_CHUNKS, keep=("topic",))
    return ch.select("chunk_id", "topic", "section", "url", "a", "b", "tokens", "text")


def q_clean_text(spark, base):
    """Cleaning alone: cleaned length and the cleaned text of every document
    that survives the 80-character floor."""
    secs = clean_sections(document_sections(marked_documents(spark, base)))
    return secs.select(F.col("page_id").alias("doc_id"), F.length("text").alias("n_chars"), "text")


def q_hash_embed(spark, base):
    """Ingest-size chunks (800/100) with their embeddings summarised."""
    ch = document_chunks(spark, base, INGEST_CHUNKS)
    return ch.select("chunk_id", "topic", "tokens", *_vec_summary("embedding"))


def q_preview(spark, base):
    docs = read_table(spark, base, "documents")
    return docs.select("doc_id", preview("text", 160).alias("preview160"),
                       preview("text", 100).alias("preview100"))


# ---------------------------------------------------------------------------
# Pages and sections
# ---------------------------------------------------------------------------
def _pages(spark, base):
    return spread(read_table(spark, base, "pages"), "page_id")


def q_html_text(spark, base):
    return scan_pages(_pages(spark, base))


def q_old_references(spark, base):
    """Old character references without a semicolon before letters and digits, as pages
    hold them: one name after the other, before each page's title."""
    import html
    names = sorted(n for n in html.entities.html5 if not n.endswith(";"))
    pages = scan_pages(read_table(spark, base, "pages")).select("page_id", "title")
    name = F.element_at(F.array(*map(F.lit, names)), (F.pmod("page_id", F.lit(len(names))) + 1).cast("int"))
    raw = F.concat(F.lit("x&"), name, F.substring(F.coalesce("title", F.lit("")), 1, 6), F.lit(" a&amp"),
                   F.col("page_id").cast("string"), F.lit(" &zz &notit;"))
    return pages.select("page_id", raw.alias("raw"), unescape_entities(raw).alias("text"))


def q_page_sections(spark, base):
    return page_sections(_pages(spark, base))


def q_page_lookup(spark, base):
    pages = scan_pages(read_table(spark, base, "pages")).select("page_id", "title")
    m = F.pmod("page_id", F.lit(3))
    topic = (F.when(m == 0, F.col("title"))
              .when(m == 1, F.concat(F.lower(F.substring("title", 1, 1)),
                                     F.substring("title", 2, 1 << 30)))
              .otherwise(F.concat(F.lit("zz "), F.col("title"))))
    req = pages.select(F.col("page_id").alias("request_id"), topic.alias("topic"))
    out = lookup_pages(req, pages)
    return out.select("request_id", "topic", "page_id", "title", "status")


def document_outline(docs: DataFrame):
    """Each document as a page whose lines are sections; levels and a few
    boilerplate titles are assigned from (doc_id, line) by a fixed rule."""
    names = list(config.BOILERPLATE_SECTIONS)

    def sec(line, i):
        n = F.col("doc_id") + i
        boiler = F.element_at(F.array(*[F.lit(" " + t.title() + " ") for t in names]),
                              (F.pmod(n, F.lit(len(names))) + 1).cast("int"))
        title = F.when(F.pmod(F.col("doc_id") * 7 + i, F.lit(5)) == 0, boiler) \
                 .otherwise(F.concat(F.lit("line "), i.cast("string")))
        return F.struct(i.cast("int").alias("ord"),
                        (F.pmod(n, F.lit(3)) + 1).cast("int").alias("level"),
                        title.alias("title"), line.alias("text"))

    return F.transform(F.split(F.col("text"), "\n"), sec)


def q_section_prune(spark, base):
    docs = _docs(spark, base)
    kept = docs.select("doc_id", F.inline(prune_boilerplate(document_outline(docs))))
    return kept.select("doc_id", "ord", "level", "title", F.length("text").alias("n_chars"))


# ---------------------------------------------------------------------------
# Store maintenance
# ---------------------------------------------------------------------------
def _store(spark, base):
    return document_chunks(spark, base, INGEST_CHUNKS)


def _store_cols(df):
    return df.select("chunk_id", "topic", "embedding_model", "tokens", "url", "section")


def q_store_merge(spark, base):
    """Upsert: chunks of English documents re-ingested under a second model
    name replace their old rows."""
    existing = _store(spark, base)
    en = document_sections(_docs(spark, base).filter(F.col("lang") == "en"))
    new = sections_to_chunks(en, INGEST_CHUNKS, EmbedOptions(model_name="model-v2"),
                             ingested_at=F.lit(1))
    return _store_cols(store.merge(existing, new))


def q_store_replace(spark, base):
    """Replace: topics re-ingested from Spanish documents only (256/32)."""
    existing = _store(spark, base)
    es = document_sections(_docs(spark, base).filter(F.col("lang") == "es"))
    new = sections_to_chunks(es, FLAGSHIP_CHUNKS, EMBED, ingested_at=F.lit(1))
    return _store_cols(store.replace_topics(existing, new))


def q_store_delete(spark, base):
    """Delete by ids: every chunk cut from a document labelled toxic."""
    existing = _store(spark, base)
    toxic = read_table(spark, base, "labels").filter(F.col("toxic") == 1).select("doc_id")
    docs = _docs(spark, base).join(toxic, "doc_id", "left_semi")
    ids = sections_to_chunks(document_sections(docs), INGEST_CHUNKS, EMBED).select("chunk_id")
    return _store_cols(store.delete_ids(existing, ids))


def _toxic_topics(spark, base):
    toxic = read_table(spark, base, "labels").filter(F.col("toxic") == 1).select("doc_id")
    docs = read_table(spark, base, "documents").join(toxic, "doc_id", "left_semi")
    return docs.select(F.col("source").alias("topic")).distinct()


def q_store_purge(spark, base):
    """Purge every topic holding a document labelled toxic."""
    return _store_cols(store.purge_topics(_store(spark, base), _toxic_topics(spark, base)))


def _wanted_topics(spark, base):
    pages = scan_pages(read_table(spark, base, "pages")).select(F.col("title").alias("topic"))
    docs = read_table(spark, base, "documents").select(F.col("source").alias("topic"))
    return docs.unionByName(pages).distinct()


def q_is_indexed(spark, base):
    return store.is_indexed(_wanted_topics(spark, base), _store(spark, base))


def q_missing_topics(spark, base):
    return store.missing_topics(_wanted_topics(spark, base), _store(spark, base))


def q_topic_counts(spark, base):
    return store.topic_counts(_store(spark, base))


def q_capacity_check(spark, base):
    """Width/dimension violations of whole documents stored as one chunk
    each (no token windows): long texts break the 65535-byte text column."""
    docs = read_table(spark, base, "documents")
    rows = docs.select(F.sha1(F.col("doc_id").cast("string")).alias("chunk_id"),
                       F.col("source").alias("topic"), "text",
                       F.lit(config.DEFAULT_MODEL).alias("embedding_model"),
                       F.lit("").alias("url"), F.col("source").alias("title"),
                       F.lit("").alias("section"),
                       F.array_repeat(F.lit(0.0).cast("float"),
                                      (F.lit(384) - F.pmod("doc_id", F.lit(2))).cast("int"))
                       .alias("embedding"))
    return store.capacity_violations(rows)


def q_store_defaults(spark, base):
    """Column defaults on raw rows with missing fields."""
    docs = read_table(spark, base, "documents")
    m = F.pmod("doc_id", F.lit(4))
    rows = docs.select(
        F.sha1(F.col("doc_id").cast("string")).alias("chunk_id"), F.col("source").alias("topic"),
        F.when(m == 0, F.lit(None)).otherwise(F.col("n_chars")).alias("tokens"),
        F.when(m == 1, F.lit(None).cast("string")).otherwise(F.lit("m")).alias("embedding_model"),
        F.when(m == 2, F.lit(None).cast("string")).otherwise(F.col("lang")).alias("url"),
        F.when(m == 3, F.lit(None).cast("string")).otherwise(F.col("source")).alias("title"),
        F.when(m != 0, F.lit(None).cast("string")).otherwise(F.lit("s")).alias("section"),
        F.when(m == 1, F.lit(None).cast("long")).otherwise(F.col("doc_id")).alias("ingested_at"))
    return store.apply_defaults(rows, ingested_at=F.lit(-1))


# ---------------------------------------------------------------------------
# Ingest and checks
# ---------------------------------------------------------------------------
def q_ingest(spark, base):
    """Pages -> sections -> clean -> chunk 800/100 -> embed -> store rows."""
    secs = page_sections(_pages(spark, base))
    rows = sections_to_chunks(secs, INGEST_CHUNKS, EMBED, ingested_at=F.lit(0))
    return rows.select("chunk_id", "topic", "title", "section", "url", "tokens", "text",
                       *_vec_summary("embedding"))


def q_ingest_counts(spark, base):
    """Sections and pieces that an ingest of all pages kept and dropped, from the one job
    that writes the rows."""
    from ..session import write_shared
    counts = IngestCounts()
    rows = sections_to_chunks(page_sections(_pages(spark, base)), ChunkOptions(34, 8), EMBED, ingested_at=F.lit(0),
                              counts=counts)
    write_shared(rows, "ingest")
    return spark.createDataFrame([counts.row()], "sections long, kept_sections long, dropped_sections long, "
                                 "pieces long, chunks long, dropped_pieces long")


def q_health_check(spark, base):
    """Health of every request; by a fixed rule some hits lack a field or their text."""
    first = F.substring(F.sha1("chunk_id"), 1, 1)
    hits = (_results(spark, base)
            .withColumn("embedding_model", F.when(first != "0", F.col("embedding_model")))
            .withColumn("text", F.when(first == "1", "").otherwise(F.col("text"))))
    return checks.health_check(_requests(spark, base), hits)


def q_ingest_report(spark, base):
    """Per wanted topic: action, stored chunks after ingest, and the top-3
    preview (query = topic) with 160-character previews."""
    from ..functions.text import py_strip
    from ..session import write_shared
    # both are read several times: chunked and scanned once
    existing = write_shared(_store(spark, base), "store")
    wanted = write_shared(_wanted_topics(spark, base), "wanted")
    flagged = _toxic_topics(spark, base).withColumn("force", F.lit(True))
    req = wanted.join(flagged, "topic", "left").withColumn(
        "force", F.coalesce(F.col("force"), F.lit(False)))
    actions = checks.ingest_actions(req, store.is_indexed(wanted, existing))
    counts = store.topic_counts(existing)
    # a topic without chunks has no preview: only the others ask
    present = store.present_topics(existing, wanted.select(py_strip(F.col("topic")).alias("topic")))
    asked = (wanted.withColumn("_t", py_strip(F.col("topic")))
             .join(present.select(F.col("topic").alias("_t")), "_t", "left_semi"))
    top = search(existing, asked.select(
        F.xxhash64("topic").alias("query_id"), "topic", F.col("topic").alias("query"),
        F.lit(3).alias("k")))
    previews = top.select("topic", "rank", "score", "tokens",
                          F.col("source.url").alias("url"), preview("text", 160).alias("preview"))
    return (actions.join(counts.select("topic", "n_chunks"), "topic", "left")
                   .join(previews, "topic", "left")
                   .select("topic", "force", "indexed", "action",
                           F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
                           "rank", "score", "tokens", "url", "preview"))


# ---------------------------------------------------------------------------
# Lessons and quizzes
# ---------------------------------------------------------------------------
def q_lesson_context(spark, base):
    return lessons.assemble_context(_results(spark, base))


def q_lesson_prompt(spark, base):
    return lessons.lesson_prompts(lessons.assemble_context(_results(spark, base)))


def _turn_pairs(spark, base):
    conv = read_table(spark, base, "conversations")
    users = conv.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("prompt_text"))
    answers = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response_text"))
    return users, answers


def q_exchange(spark, base):
    """User turns as prompts, the following assistant turns as responses."""
    users, answers = _turn_pairs(spark, base)
    pid = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    prompts = users.select(pid.alias("prompt_id"), F.col("conv_id").cast("string").alias("topic"),
                           F.lit("lesson").alias("kind"), F.col("prompt_text").alias("text"))
    responses = answers.select(pid.alias("prompt_id"), F.col("response_text").alias("text"))
    return lessons.exchange(prompts, responses).select(
        "prompt_id", "topic", "kind", F.length("text").alias("prompt_chars"), "response")


def q_quiz_prompt(spark, base):
    """Quiz prompts from lessons (assistant answers)."""
    _, answers = _turn_pairs(spark, base)
    pid = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    les = answers.select(pid.alias("prompt_id"), F.col("conv_id").cast("string").alias("topic"),
                         F.col("response_text").alias("lesson"))
    return lessons.quiz_prompts(les)


def quiz_text(docs: DataFrame):
    """A generated-quiz text per document: every line becomes a question;
    lines with at least four words get four options (answer: the second),
    every fourth line is open-ended.  (Two staged transforms: the words of a
    line are split once, not once per use inside the lambda.)"""
    lines = F.transform(F.split(F.col("text"), "\n"), lambda line, i: F.struct(
        line.alias("line"), i.alias("i"), F.split(py_space(line), " ").alias("words")))

    def block(s):
        words = s["words"]
        w = [F.coalesce(F.try_element_at(words, F.lit(j)), F.lit("")) for j in (1, 2, 3, 4)]
        mc = (F.pmod(s["i"], F.lit(4)) != 3) & (F.size(words) >= 4)
        opts = F.concat(F.lit("OPTIONS: A) "), w[0], F.lit(" B) "), w[1], F.lit(" C) "), w[2],
                        F.lit(" D) "), w[3], F.lit("\n"))
        return F.concat(F.lit("QUESTION: "), s["line"], F.lit("?\n"),
                        F.when(mc, opts).otherwise(F.lit("")),
                        F.lit("ANSWER: "), F.when(mc, F.concat(F.lit("B) "), w[1]))
                        .otherwise(F.element_at(words, -1)), F.lit(" |||"))
    return F.array_join(F.transform(lines, block), "\n")


def py_space(col):
    from ..functions.text import collapse_whitespace
    return collapse_whitespace(col)


def q_quiz_parse(spark, base):
    docs = _docs(spark, base)
    src = docs.select(F.col("doc_id"), quiz_text(docs).alias("text"))
    qs = quiz.quiz_questions(src, key="doc_id")
    opts = F.array_join(F.transform(F.map_entries("options"),
                                    lambda e: F.concat(e["key"], F.lit(")"), e["value"])), "|")
    return qs.select("doc_id", "pos", "type", "question", opts.alias("options"),
                     F.when(F.col("options").isNotNull(), F.size("options")).alias("n_options"),
                     "correct_answer")


def q_quiz_collect(spark, base):
    docs = _docs(spark, base)
    src = docs.select("doc_id", "source", quiz.parse_quiz(quiz_text(docs)).alias("quiz"))
    chk = quiz.quiz_check(F.col("quiz"))
    return src.select("doc_id", "source", F.size("quiz").alias("n_questions"),
                      chk["n_multiple_choice"].alias("n_multiple_choice"),
                      chk["n_open_ended"].alias("n_open_ended"), chk["ok"].alias("ok"))


def q_lessons(spark, base):
    """Lesson rows from documents (lesson = text, quiz parsed from its quiz
    text, created_at from the id), validated, previewed, numbered newest
    first."""
    docs = _docs(spark, base)
    rows = docs.select(
        "doc_id", F.when(F.pmod("doc_id", F.lit(9)) == 0, F.lit("")).otherwise(F.col("source"))
        .alias("topic"), F.col("text").alias("lesson"),
        F.struct(quiz.parse_quiz(quiz_text(docs)).alias("quiz")).alias("quiz"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60).alias("created_at"))
    valid, _ = lessons.validate_lessons(rows)
    listed = lessons.global_rank(valid, F.col("created_at").desc(), F.col("doc_id"), name="n")
    return listed.select("n", "doc_id", "topic",
                         lessons.lesson_preview("lesson").alias("preview"),
                         F.size("quiz.quiz").alias("n_questions"))


QUERIES = {
    "retrieve": q_retrieve,
    "topk_vectors": q_topk_vectors,
    "topk_vectors_ip": q_topk_vectors_ip,
    "query_embed": q_query_embed,
    "clean_text": q_clean_text,
    "clean_chunk": q_clean_chunk,
    "hash_embed": q_hash_embed,
    "preview": q_preview,
    "html_text": q_html_text,
    "old_references": q_old_references,
    "page_sections": q_page_sections,
    "page_lookup": q_page_lookup,
    "section_prune": q_section_prune,
    "store_merge": q_store_merge,
    "store_replace": q_store_replace,
    "store_delete": q_store_delete,
    "store_purge": q_store_purge,
    "is_indexed": q_is_indexed,
    "missing_topics": q_missing_topics,
    "topic_counts": q_topic_counts,
    "capacity_check": q_capacity_check,
    "store_defaults": q_store_defaults,
    "ingest": q_ingest,
    "ingest_counts": q_ingest_counts,
    "health_check": q_health_check,
    "ingest_report": q_ingest_report,
    "lesson_context": q_lesson_context,
    "lesson_prompt": q_lesson_prompt,
    "exchange": q_exchange,
    "quiz_prompt": q_quiz_prompt,
    "quiz_parse": q_quiz_parse,
    "quiz_collect": q_quiz_collect,
    "lessons": q_lessons,
}


# ---------------------------------------------------------------------------
# Streaming
# ---------------------------------------------------------------------------
def q_stream_ingest(spark, base):
    """Documents ingested by the incremental stream (800/100), read back from
    the stream's parquet sink; equal to the batch ``hash_embed`` rows."""
    from ..streaming.ingest import run_ingest
    pattern = f"{base.rstrip('/')}/documents*.parquet"
    sink = run_ingest(spark, pattern)
    ch = spark.read.parquet(sink)
    return ch.select("chunk_id", "topic", "tokens", *_vec_summary("embedding"))


QUERIES["stream_ingest"] = q_stream_ingest


def q_store_versioned(spark, base):
    """The merge of ``store_merge`` through the on-disk store: write all
    chunks as version 1 in a fresh store in the shared checkpoint folder,
    upsert the re-ingested English chunks (only their buckets are rewritten),
    read the current snapshot back."""
    import uuid

    from ..session import shared_path
    cs = store.ChunkStore(spark, shared_path(spark, f"store-{uuid.uuid4().hex[:12]}"), buckets=8)
    cs.write(_store(spark, base))
    en = document_sections(_docs(spark, base).filter(F.col("lang") == "en"))
    cs.upsert(sections_to_chunks(en, INGEST_CHUNKS, EmbedOptions(model_name="model-v2"),
                                 ingested_at=F.lit(1)))
    return _store_cols(cs.read())


QUERIES["store_versioned"] = q_store_versioned


def q_section_tree(spark, base):
    """Each document as a page whose lines form a tree by parent pointers
    (line i hangs under line (i-1)/2), boilerplate titles assigned as in
    ``section_prune``; flattened to pre-order with boilerplate subtrees
    dropped."""
    from ..operators.sections import flatten_tree
    docs = _docs(spark, base)
    names = list(config.BOILERPLATE_SECTIONS)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    n = F.col("doc_id") + F.col("i")
    boiler = F.element_at(F.array(*[F.lit(" " + t.title() + " ") for t in names]),
                          (F.pmod(n, F.lit(len(names))) + 1).cast("int"))
    secs = lines.select(
        F.col("doc_id").alias("page_id"), F.col("i").cast("int").alias("node"),
        F.when(F.col("i") > 0, F.floor((F.col("i") - 1) / 2)).cast("int").alias("parent"),
        F.col("i").cast("int").alias("ord"),
        F.when(F.pmod(F.col("doc_id") * 7 + F.col("i"), F.lit(5)) == 0, boiler)
         .otherwise(F.concat(F.lit("line "), F.col("i").cast("string"))).alias("title"),
        F.length("line").alias("n_chars"))
    flat = flatten_tree(secs)
    return flat.select(F.col("page_id").alias("doc_id"), "node", "level", "pre", "title", "n_chars")


QUERIES["section_tree"] = q_section_tree


def q_service_get_chunks(spark, base):
    """The on-demand flow end to end: every distinct page title is requested
    (query = the title, k = 4); the service resolves titles to pages,
    ingests the missing topics into a fresh versioned store in the shared
    checkpoint folder, and answers from the stored chunks."""
    import uuid

    from ..session import shared_path
    from ..sources.pages import page_titles
    from .service import Retrieval
    pages = _pages(spark, base)
    cs = store.ChunkStore(spark, shared_path(spark, f"svc-{uuid.uuid4().hex[:12]}"), buckets=8)
    titles = page_titles(read_table(spark, base, "pages"))
    svc = Retrieval(spark, cs, pages, titles=titles)
    req = titles.select("title").distinct().select(
        F.xxhash64("title").alias("query_id"), F.col("title").alias("topic"),
        F.col("title").alias("query"), F.lit(4).alias("k"))
    return flatten_source(svc.get_chunks(req)[0]).drop("query_id")


QUERIES["service_get_chunks"] = q_service_get_chunks


def q_lookup_lang(spark, base):
    """Every page title, asked for among the pages in one language only."""
    from ..sources.pages import page_titles
    titles = page_titles(read_table(spark, base, "pages"))
    req = titles.select(F.col("page_id").alias("request_id"), F.col("title").alias("topic"))
    out = lookup_pages(req, titles, lang="fr")
    return out.select("request_id", "topic", "page_id", "title", "status")


def q_embed_truncated(spark, base):
    """Ingest-size chunks embedded from their first 64 tokens only."""
    ch = document_chunks(spark, base, INGEST_CHUNKS, EmbedOptions(max_seq_length=64))
    return ch.select("chunk_id", "topic", "tokens", *_vec_summary("embedding"))


def _service(spark, base, name: str, titles, pages=None):
    import uuid

    from ..session import shared_path
    from .service import Retrieval
    cs = store.ChunkStore(spark, shared_path(spark, f"{name}-{uuid.uuid4().hex[:12]}"), buckets=8)
    return Retrieval(spark, cs, pages if pages is not None else _pages(spark, base), titles=titles)


def _title_requests(titles):
    return titles.select("title").distinct().select(
        F.xxhash64("title").alias("query_id"), F.col("title").alias("topic"),
        F.col("title").alias("query"), F.lit(4).alias("k"))


def q_service_rejects(spark, base):
    """What the service could not answer: for every page title a request with a
    blank topic, one with k = 0, one for a title that does not exist, and one for
    the page without its content or with too little of it."""
    from ..sources.pages import page_titles
    pages = read_table(spark, base, "pages")
    body = F.when(F.pmod("page_id", F.lit(2)) == 0, F.lit("<body></body>")) \
        .otherwise(F.lit("<body><h2>a</h2>short</body>"))
    bare = pages.select("page_id", "url", F.concat(
        F.lit("<html><head><title>bare "), F.col("page_id").cast("string"),
        F.lit("</title></head>"), body, F.lit("</html>")).alias("html"))
    titles = page_titles(bare)
    kind = F.explode(F.array(*[F.lit(i) for i in range(4)]))
    req = titles.select("page_id", "title", kind.alias("kind")).select(
        (F.col("page_id") * 4 + F.col("kind")).alias("query_id"),
        F.when(F.col("kind") == 0, F.lit(" \t")).when(F.col("kind") == 2, F.concat(F.lit("zz "), "title"))
        .otherwise(F.col("title")).alias("topic"),
        F.lit(None).cast("string").alias("query"),
        F.when(F.col("kind") == 1, F.lit(0)).otherwise(F.lit(3)).alias("k"))
    hits, rejects = _service(spark, base, "rejects", titles, bare).get_chunks(req)
    return rejects.select("query_id", "topic", "reason")


def _reingested(spark, base, mode: str):
    """All topics stored with 800/100 windows, then ingested anew with 256/32."""
    import dataclasses

    from ..sources.pages import page_titles
    titles = page_titles(read_table(spark, base, "pages"))
    svc = _service(spark, base, f"reingest-{mode}", titles)
    topics = _title_requests(titles).select("topic")
    svc.ensure_indexed(topics)
    svc.chunk_options = dataclasses.replace(INGEST_CHUNKS, max_tokens=256, overlap=32)
    svc.reingest(topics, mode)
    return svc.store.read().select("topic", "chunk_id", "tokens", F.md5("text").alias("text_md5"))


def q_reingest_merge(spark, base):
    return _reingested(spark, base, "merge")


def q_reingest_replace(spark, base):
    return _reingested(spark, base, "replace")


def q_single_request(spark, base):
    """One call over the chunks of all documents: the topic with the most
    documents, asked for by its own name."""
    docs = read_table(spark, base, "documents")
    topic = (docs.groupBy("source").count().orderBy(F.col("count").desc(), "source").first()["source"])
    from ..operators.search import get_chunks
    return flatten_source(get_chunks(spark, document_chunks(spark, base), f" {topic} ", None, 6,
                                     embed_options=EMBED))


QUERIES.update({
    "lookup_lang": q_lookup_lang,
    "embed_truncated": q_embed_truncated,
    "service_rejects": q_service_rejects,
    "reingest_merge": q_reingest_merge,
    "reingest_replace": q_reingest_replace,
    "single_request": q_single_request,
})


def q_content_flow(spark, base):
    """Every document's hits become a lesson with a quiz, saved and read back.
    The responses are derived from the documents: the lesson is the text, the
    quiz its generated quiz text; every ninth document got no lesson."""
    import uuid

    from ..session import shared_path
    from .content import generate_content
    docs = _docs(spark, base)
    path = shared_path(spark, f"lessons-{uuid.uuid4().hex[:12]}")
    given = docs.filter(F.pmod("doc_id", F.lit(9)) != 0).select(
        F.concat(F.lit("lesson-"), F.col("doc_id").cast("string")).alias("prompt_id"),
        F.concat(F.lit(" \n"), F.col("text"), F.lit("\t ")).alias("text"))
    quizzes = docs.select(
        F.concat(F.lit("quiz-lesson-"), F.col("doc_id").cast("string")).alias("prompt_id"),
        quiz_text(docs).alias("text"))
    # each kind of prompt asks the responses of its kind: the others are not moved
    responses = given.withColumn("kind", F.lit("lesson")).unionByName(quizzes.withColumn("kind", F.lit("quiz")))
    generate_content(_results(spark, base),
                     lambda prompts: responses.join(prompts.select("prompt_id", "kind"), ["prompt_id", "kind"],
                                                    "left_semi").drop("kind"),
                     path)
    return lessons.read_lessons(
        spark, path, "topic", F.md5("lesson").alias("lesson_md5"), F.size("quiz.quiz").alias("n_questions"),
        F.size("retrieved_chunks").alias("n_chunks"),
        F.array_join(F.col("retrieved_chunks.chunk_id"), ",").alias("chunk_ids"))


QUERIES["content_flow"] = q_content_flow


def _colliding(spark, base) -> DataFrame:
    """Page chunks as if all sections of a page had the same name."""
    secs = page_sections(_pages(spark, base)).withColumn("title", F.lit("Same")) \
        .withColumn("url", F.concat(F.col("topic"), F.lit("#Same")))
    return sections_to_chunks(secs, ChunkOptions(max_tokens=34, overlap=8), EMBED,
                              ingested_at=F.lit(0), extra=PLACE)


def q_ingest_first(spark, base):
    """Rows with one key: the first section of the lowest page wins."""
    return first_sections(_colliding(spark, base)).select(
        "topic", "chunk_id", "tokens", F.md5("text").alias("text_md5"))


def q_ingest_dropped(spark, base):
    """How many rows of each topic lose to an earlier one with the same key."""
    return store.dropped_rows(_colliding(spark, base))


QUERIES.update({"ingest_first": q_ingest_first, "ingest_dropped": q_ingest_dropped})


def q_stream_store(spark, base):
    """The stream into a chunk store, run twice over the same files: the second
    run changes nothing."""
    import uuid

    from ..session import shared_path
    from ..streaming.ingest import run_ingest
    cs = store.ChunkStore(spark, shared_path(spark, f"stream-store-{uuid.uuid4().hex[:12]}"), buckets=8)
    for _ in range(2):
        run_ingest(spark, f"{base.rstrip('/')}/documents*.parquet", store=cs)
    return cs.read().select("chunk_id", "topic", "tokens", F.md5("text").alias("text_md5"))


QUERIES["stream_store"] = q_stream_store


# ---------------------------------------------------------------------------
# User hooks, and the store's file filters
# ---------------------------------------------------------------------------
def q_user_chunker(spark, base):
    """A chunker of the user's, called from Spark SQL as a table function."""
    from ..functions.tables import register_chunker
    register_chunker(spark, "word_chunks")
    _docs(spark, base).createOrReplaceTempView("chunked_docs")
    return spark.sql("SELECT d.doc_id, c.piece, c.a, c.b, md5(c.text) AS text_md5 "
                     "FROM chunked_docs d, LATERAL word_chunks(d.text, 120, 20) c")


def letter_model():
    """A model of the user's: length, spaces, vowels and digits of a text."""
    import numpy as np

    def encode(texts: list) -> np.ndarray:
        return np.array([[len(t), t.count(" "), sum(t.count(v) for v in "aeiou"), sum(t.count(d) for d in "0123456789")]
                         for t in texts], np.float32).reshape(len(texts), 4)
    return encode


def q_model_embed(spark, base):
    """Vectors of a model of the user's, in Arrow batches, unit length."""
    from ..operators.embed import embed_with_model
    docs = _docs(spark, base).select("doc_id", "text")
    out = embed_with_model(docs, letter_model)
    return out.select("doc_id", *[F.round(F.get("embedding", F.lit(j)).cast("double"), 3).alias(f"v{j}")
                                  for j in range(4)])


def q_store_delete_written(spark, base):
    """``store_delete`` over a written store: row groups without the ids are skipped."""
    import uuid

    from ..session import shared_path
    cs = store.ChunkStore(spark, shared_path(spark, f"store-{uuid.uuid4().hex[:12]}"), buckets=8)
    cs.write(_store(spark, base))
    toxic = read_table(spark, base, "labels").filter(F.col("toxic") == 1).select("doc_id")
    docs = _docs(spark, base).join(toxic, "doc_id", "left_semi")
    cs.delete(sections_to_chunks(document_sections(docs), INGEST_CHUNKS, EMBED).select("chunk_id"))
    return _store_cols(cs.read())


def q_exchange_stream(spark, base):
    """``exchange`` as a join of two streams, in several micro-batches."""
    import uuid

    from ..session import shared_path
    from ..streaming.exchange import run_exchange, write_in_order
    users, answers = _turn_pairs(spark, base)
    pid = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    at = F.timestamp_seconds(86_400 + F.col("conv_id") * 60 + F.col("turn"))  # watermarks start at 0
    root = shared_path(spark, f"exchange-{uuid.uuid4().hex[:12]}")
    write_in_order(users.select(pid.alias("prompt_id"), F.col("conv_id").cast("string").alias("topic"),
                                F.lit("lesson").alias("kind"), F.col("prompt_text").alias("text"), at.alias("at")),
                   f"{root}/prompts", "at", 3)
    write_in_order(answers.select(pid.alias("prompt_id"), F.col("response_text").alias("text"),
                                  (at + F.expr("INTERVAL 30 SECONDS")).alias("at")), f"{root}/responses", "at", 3)
    out = run_exchange(spark, f"{root}/prompts", f"{root}/responses", f"{root}/out", f"{root}/state")
    return out.select("prompt_id", "topic", "kind", F.length("text").alias("prompt_chars"), "response")


QUERIES.update({"user_chunker": q_user_chunker, "model_embed": q_model_embed,
                "store_delete_written": q_store_delete_written, "exchange_stream": q_exchange_stream})


from .vectors import VECTOR_QUERIES  # noqa: E402  (it uses the helpers above)

QUERIES.update(VECTOR_QUERIES)


def _counted_stream(spark, base) -> str:
    """The store's chunks as several files, counted in as many micro-batches."""
    import uuid

    from ..session import shared_path
    root = shared_path(spark, f"topic-stream-{uuid.uuid4().hex[:12]}")
    _store(spark, base).select("topic", "chunk_id").repartition(4, "chunk_id").write.parquet(f"{root}/in")
    topics.run_counts(spark, f"{root}/in", f"{root}/counts", f"{root}/_checkpoint", max_files=1)
    return f"{root}/counts"


def q_stream_topic_counts(spark, base):
    return topics.running_counts(spark, _counted_stream(spark, base))


def q_stream_missing_topics(spark, base):
    return topics.still_missing(_wanted_topics(spark, base), _counted_stream(spark, base))


QUERIES.update({"stream_topic_counts": q_stream_topic_counts, "stream_missing_topics": q_stream_missing_topics})
