"""Content generation end to end, as one plan over many requests.

retrieved chunks -> lesson prompts -> responses -> quiz prompts -> responses ->
parsed questions -> checked lessons -> lessons table.  The model that answers
prompts is outside: ``answer`` turns a prompts table into a responses table
(``prompt_id, text``), for example by joining answers that a batch service
wrote.  Every step is a column expression or a join on ``prompt_id``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lessons import (append_lessons, assemble_context, exchange, lesson_prompts,
                                 quiz_prompts)
from ..operators.quiz import parse_quiz
from ..schemas import LESSONS

Answer = Callable[[DataFrame], DataFrame]


def retrieved_chunks(hits: DataFrame, key: str = "query_id", keep: tuple = ()) -> DataFrame:
    """Per request: its hits in rank order, as the lessons table stores them.  ``keep``:
    columns that the hits of a request have in common."""
    kind = LESSONS["retrieved_chunks"].dataType
    names = [f.name for f in kind.elementType.fields]
    rows = F.array_sort(F.collect_list(F.struct(
        F.col("rank").alias("_rank"), F.struct(*[F.col(n).alias(n) for n in names]).alias("hit"))))
    return hits.groupBy(key).agg(F.transform(rows, lambda h: h["hit"]).cast(kind)
                                 .alias("retrieved_chunks"), *[F.first(c).alias(c) for c in keep])


def build_lessons(hits: DataFrame, answer: Answer, key: str = "query_id") -> DataFrame:
    """``key, topic, lesson, quiz, retrieved_chunks`` of every request with hits.

    A prompt without a response leaves its field null, so that the check before
    saving rejects the row instead of losing it."""
    prompts = lesson_prompts(assemble_context(hits, key), key)
    lessons = exchange(prompts, answer(prompts)).select("prompt_id", "topic",
                                                        F.col("response").alias("lesson"))
    asked = quiz_prompts(lessons.filter(F.coalesce("lesson", F.lit("")) != ""))
    quizzes = exchange(asked, answer(asked)).select(
        F.expr("substring(prompt_id, 6)").alias("prompt_id"),  # without 'quiz-'
        F.when(F.col("response").isNotNull(), F.struct(parse_quiz(F.col("response")).alias("quiz")))
        .alias("quiz"))
    # grouped by the key of the join: the hits' texts are moved once
    chunks = retrieved_chunks(hits.withColumn("prompt_id", F.concat(F.lit("lesson-"), F.col(key).cast("string"))),
                              "prompt_id", (key,))
    return (lessons.join(quizzes, "prompt_id", "left").join(chunks, "prompt_id")
            .select(key, "topic", "lesson", "quiz", "retrieved_chunks"))


def generate_content(hits: DataFrame, answer: Answer, path: str,
                     key: str = "query_id") -> DataFrame:
    """Build the lessons of all requests and append the valid ones to the table
    at ``path``; returns the rejected rows."""
    rows = build_lessons(hits, answer, key).drop(key)
    return append_lessons(rows, path)
