"""No step of the near-duplicate search is one plan of joins of joins: the driver keeps plans and
broadcasts of every join in its memory."""

from folio.llm import _util, jaccard


def test_steps_of_the_search_have_small_plans(spark, monkeypatch):
    joins = []

    def staged(df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins.append((plan.count("Join "), name))
        return _util.stage_table(df, name)

    monkeypatch.setattr(jaccard, "stage_table", staged)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[:-1] + [f"x{i}"]) for i in range(6)]
    texts += [" ".join(words[20:] + [f"y{i}" for i in range(20)]), " ".join(f"z{i}" for i in range(30)), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(docs, percent=80, tile=2).collect()}
    assert got == {**dict.fromkeys(range(6), 0), 6: 6, 7: 7, 8: 8, 9: 9}
    assert max(joins)[0] <= 6, max(joins)


def test_few_links_need_no_steps(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(_util, "stage_table", lambda df, name, real=_util.stage_table: staged.append(name) or real(df, name))
    path = [(i, i + 1) for i in range(30)] + [(101, 100), (100, 101), (7, 7), (None, 3)]
    edges = spark.createDataFrame(path, "a long, b long").coalesce(1)
    got = {r.node: r.component for r in _util.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100}
    assert len(staged) == 1


def test_leaves_are_dealt_out_once(spark, monkeypatch):
    """The leaves, most of what the search writes, are cut once and go through one shuffle."""
    plans = []

    def staged(df, name):
        if name == "members" and not plans:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return _util.stage_table(df, name)

    monkeypatch.setattr(jaccard, "stage_table", staged)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(words[:-1] + [f"x{i}"])) for i in range(6)] + [(6, "alone"), (7, None)],
                                 "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan then names what it uses again
    try:
        got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(docs, percent=80).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == {**dict.fromkeys(range(6), 0), 6: 6, 7: 7}
    assert plans[0].count("MapInArrow") == 1 and plans[0].count("ReusedExchange") == 1
