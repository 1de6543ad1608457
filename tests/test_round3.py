"""Streams of prompts and responses, user chunkers and models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.streaming.exchange import run_exchange, write_in_order


def _turns(spark, n, first=0):
    at = F.timestamp_seconds(86_400 + F.col("id") * 60)
    p = spark.range(first, n).select(F.concat(F.lit("p"), "id").alias("prompt_id"), F.lit("t").alias("topic"),
                                     F.lit("lesson").alias("kind"), F.col("id").cast("string").alias("text"), at.alias("at"))
    r = (spark.range(first, n).where("id % 3 <> 0")
         .select(F.concat(F.lit("p"), "id").alias("prompt_id"), F.concat(F.lit(" r"), "id", F.lit("\n")).alias("text"),
                 (at + F.expr("INTERVAL 40 SECONDS")).alias("at")))
    return p, r


def test_exchange_stream_and_restart(spark, tmp_dir):
    from folio.operators.lessons import exchange
    p, r = _turns(spark, 90)
    want = sorted((x.prompt_id, x.response) for x in exchange(p, r).collect())
    write_in_order(p, f"{tmp_dir}/p", "at", 3)
    write_in_order(r, f"{tmp_dir}/r", "at", 2)
    args = (spark, f"{tmp_dir}/p", f"{tmp_dir}/r", f"{tmp_dir}/out", f"{tmp_dir}/state")
    first = sorted((x.prompt_id, x.response) for x in run_exchange(*args).collect())
    assert first == want and sum(b is None for _, b in want) == 30
    # a second start gives nothing twice, and new turns follow on
    again = sorted((x.prompt_id, x.response) for x in run_exchange(*args).collect())
    assert again == want
    day = 60 * 24 * 40
    p2, r2 = _turns(spark, day + 30, day)
    write_in_order(p2, f"{tmp_dir}/p", "at", 2)
    write_in_order(r2, f"{tmp_dir}/r", "at", 2)
    more = sorted((x.prompt_id, x.response) for x in run_exchange(*args).collect())
    assert more == sorted(want + [(x.prompt_id, x.response) for x in exchange(p2, r2).collect()])


def test_user_chunker_in_sql(spark):
    from folio.functions.tables import register_chunker
    register_chunker(spark, "letters_of", spans=lambda text, size, overlap: [(0, len(text))], split=list)
    register_chunker(spark, "words_of")
    spark.createDataFrame([(1, "a b c d e"), (2, None), (3, " "), (4, "x")], "id int, t string") \
        .createOrReplaceTempView("texts_of")
    got = spark.sql("select id, c.* from texts_of, lateral words_of(t, 3, 1) c").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 3, "a b c"), (1, 1, 2, 5, "c d e"), (4, 0, 0, 1, "x")]
    got = spark.sql("select c.text from texts_of, lateral letters_of(t, 3, 1) c where id = 4").collect()
    assert [r.text for r in got] == ["x"]
    for bad in ("words_of(t, 0, 0)", "words_of(t, 3, 3)", "words_of(id, 3, 1)", "words_of(t, id, 1)"):
        with pytest.raises(Exception, match="must be|less than"):
            spark.sql(f"select c.* from texts_of, lateral {bad} c").collect()


def test_letter_model(spark):
    from folio.operators.embed import embed_with_model
    from folio.plans.queries import letter_model
    df = spark.createDataFrame([(1, "a 1"), (2, None), (3, "")], "id int, text string")
    got = {r.id: r.embedding for r in embed_with_model(df, letter_model).collect()}
    raw = np.array([3, 1, 1, 1]) / np.sqrt(12)
    assert np.allclose(got[1], raw, atol=1e-6) and got[2] == got[3] == [0, 0, 0, 0]


def test_running_topic_counts_go_on_after_a_stop(spark, tmp_path):
    """Files that come between two runs are counted once; null topics too."""
    from folio.operators.store import topic_counts
    from folio.streaming.topics import run_counts, running_counts, still_missing
    chunks = spark.range(300).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("t"), F.col("id") % 7)).alias("topic"),
                                     F.col("id").cast("string").alias("chunk_id"))
    where = [str(tmp_path / x) for x in ("in", "counts", "state")]
    for low, high in ((0, 100), (100, 103), (103, 103), (103, 300)):
        part = chunks.where(F.col("chunk_id").cast("long").between(low, high - 1))
        part.repartition(2).write.mode("append").parquet(where[0])
        run_counts(spark, *where, max_files=1)
        seen = chunks.where(F.col("chunk_id").cast("long") < high)
        got = sorted(map(tuple, running_counts(spark, where[1], window=20).collect()), key=str)
        assert got == sorted(map(tuple, topic_counts(seen, 20).collect()), key=str)
    wanted = spark.createDataFrame([(" t1 ",), ("t9",), ("t9",)], "topic string")
    assert [r.topic for r in still_missing(wanted, where[1]).collect()] == ["t9"]
