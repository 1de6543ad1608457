"""The stream's upsert: only rows whose key repeats, and only keys, are shuffled."""

from pyspark.sql import functions as F

from folio.operators import store
from folio.streaming import ingest


def _rows(spark, values):
    return spark.createDataFrame(values, "topic string, chunk_id string, url string, section string, text string")


ONCE = [("a", "1", "u", "s", "x"), ("a", None, "u", "s", "x"), (None, None, "u", "s", "x"), ("b", "1", "u", "s", "x")]
TWICE = [("a", "1", "t", "s", "y"), (None, None, "u", "r", "z"), ("a", None, "u", None, "x"), ("a", None, "u", "s", "x")]


def _sorted(df):
    return sorted(df.select("topic", "chunk_id", "url", "section", "text").collect(), key=str)


def test_upsert_writes_a_batch_before_any_shuffle(spark, monkeypatch):
    plans, given = [], []

    def written(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store.materialize(df)

    class Store:
        def upsert(self, rows, materialized):
            given.append(rows)

    monkeypatch.setattr(ingest, "materialize", written)
    for values in (ONCE, ONCE + TWICE, []):
        ingest._upsert(Store(), _rows(spark, values))
    assert len(plans) == 3 and not any("Window" in p or "Exchange" in p for p in plans)
    assert len(given) == 2  # an empty batch changes nothing
    for rows, values in zip(given, (ONCE, ONCE + TWICE)):
        assert _sorted(rows) == _sorted(store.dedup_new(_rows(spark, values)))


def test_merge_with_many_keys_gives_what_few_keys_give(spark):
    old = _rows(spark, ONCE + TWICE + [("c", "9", "u", "s", "x")] * 2)
    for new in (ONCE[:1], ONCE, [("c", "9", "u", "s", "new")], []):
        for key in (("topic", "chunk_id"), ("chunk_id",)):
            few, many = (store.merge(old, _rows(spark, new), key, max_broadcast_rows=n) for n in (100, 0))
            assert _sorted(many) == _sorted(few)


def test_merge_of_all_rows_again_moves_no_texts(spark):
    rows = store.materialize(spark.range(50).select(
        F.lit("t").alias("topic"), F.col("id").cast("string").alias("chunk_id"), F.lit("u").alias("url"),
        F.lit("s").alias("section"), F.lit("x").alias("text")))
    merged = store.merge(rows, rows, max_broadcast_rows=0)
    merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert merged.count() == 50 and "SortMergeJoin" not in plan
