"""Explicit schemas for every stage.  Nothing downstream relies on inference."""

from __future__ import annotations

from pyspark.sql import types as T

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("topic", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
])

SECTIONS = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("topic", T.StringType()),
    T.StructField("ord", T.IntegerType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("title", T.StringType(), True),
    T.StructField("text", T.StringType()),
    T.StructField("url", T.StringType()),
])

CHUNKS = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("tokens", T.LongType()),
    T.StructField("embedding_model", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("section", T.StringType()),
    T.StructField("ingested_at", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

REQUESTS = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("topic", T.StringType()),
    T.StructField("query", T.StringType(), True),
    T.StructField("k", T.IntegerType()),
])

SOURCE = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("section", T.StringType()),
])

RESULTS = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("topic", T.StringType()),
    T.StructField("chunk_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("tokens", T.LongType()),
    T.StructField("embedding_model", T.StringType()),
    T.StructField("source", SOURCE),
])

PROMPTS = T.StructType([
    T.StructField("prompt_id", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()),
])

RESPONSES = T.StructType([
    T.StructField("prompt_id", T.StringType()),
    T.StructField("text", T.StringType()),
])

QUESTION = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("options", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("correct_answer", T.StringType()),
])

QUESTIONS = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("pos", T.IntegerType()),
] + list(QUESTION.fields))

LESSONS = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("lesson", T.StringType()),
    T.StructField("quiz", T.StructType([T.StructField("quiz", T.ArrayType(QUESTION))])),
    T.StructField("retrieved_chunks", T.ArrayType(T.StructType(
        [f for f in RESULTS.fields]))),
    T.StructField("created_at", T.TimestampType()),
])
