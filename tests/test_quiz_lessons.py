from pyspark.sql import functions as F

from folio import config
from folio.operators import lessons, quiz

QUIZ = """Here you go.
QUESTION: What is a vector space?
OPTIONS: A) A set  B) A field C) A ring D) A group
ANSWER: A) A set |||
QUESTION: Pick one
OPTIONS: A) first
continued B) second C) third D) fourth
ANSWER: C |||
QUESTION: Missing answer
OPTIONS: A) x B) y
QUESTION: Explain eigenvalues.
ANSWER: They scale eigenvectors. |||
QUESTION: Empty answer ok
ANSWER:
QUESTION: Repeated letters
OPTIONS: A) one B) two A) three
ANSWER: B |||"""


def test_parse_quiz_literal(spark):
    df = spark.createDataFrame([("p1", QUIZ)], "prompt_id string, text string")
    rows = quiz.quiz_questions(df).orderBy("pos").collect()
    got = [(r.type, r.question, dict(r.options) if r.options is not None else None, r.correct_answer)
           for r in rows]
    assert got == [
        ("multiple_choice", "What is a vector space?",
         {"A": "A set", "B": "A field", "C": "A ring", "D": "A group"}, "A) A set |||"),
        ("multiple_choice", "Pick one", {"B": "second", "C": "third", "D": "fourth"}, "C |||"),
        ("open_ended", "Explain eigenvalues.", None, "They scale eigenvectors. |||"),
        ("open_ended", "Empty answer ok", None, ""),
        ("multiple_choice", "Repeated letters", {"A": "three", "B": "two"}, "B |||"),
    ]


def test_quiz_check_counts(spark):
    df = spark.createDataFrame([(QUIZ,)], "t string")
    c = df.select(quiz.quiz_check(quiz.parse_quiz(F.col("t"))).alias("c")).first().c
    assert (c.n_multiple_choice, c.n_open_ended, c.ok) == (3, 2, False)


def test_context_citations_and_prompt(spark):
    hits = spark.createDataFrame(
        [(1, "T", 2, "second {sources} text", ("wikipedia", "u2", "Title", "")),
         (1, "T", 1, "first", ("wikipedia", "u1", "Title", "Sec")),
         (1, "T", 3, "   no metadata at all here " + "x" * 60, ("wikipedia", "", "", ""))],
        "query_id long, topic string, rank int, text string, "
        "source struct<kind:string,url:string,title:string,section:string>")
    ctx = lessons.assemble_context(hits, max_chars=30).first()
    assert ctx.context == ("first\n\nsecond {sources} text\n\n   no metadata at all here " + "x" * 60)[:30]
    assert ctx.truncated
    assert ctx.sources.split("\n") == [
        "- Title (u1), Section: Sec", "- Title (u2)",
        "- " + ("   no metadata at all here " + "x" * 60)[:50].strip() + "... (No source metadata provided)"]
    prompt = lessons.lesson_prompts(lessons.assemble_context(hits)).first().text
    want = config.LESSON_PROMPT.replace("{sources}", "\x00").replace(
        "{context}", "first\n\nsecond {sources} text\n\n   no metadata at all here " + "x" * 60)
    want = want.replace("\x00", "- Title (u1), Section: Sec\n- Title (u2)\n- "
                        + ("   no metadata at all here " + "x" * 60)[:50].strip()
                        + "... (No source metadata provided)")
    assert prompt == want


def test_lesson_validation_preview_and_rank(spark):
    rows = spark.createDataFrame(
        [("T", "L" * 600, 3), ("", "x", 2), ("U", "short", 1), ("V", "", 4)],
        "topic string, lesson string, ts long")
    rows = rows.withColumn("quiz", F.struct(F.array().cast("array<string>").alias("quiz")))
    valid, rejected = lessons.validate_lessons(rows)
    assert sorted(r.topic for r in valid.collect()) == ["T", "U"]
    assert rejected.count() == 2
    prev = {r.topic: r.p for r in valid.select("topic", lessons.lesson_preview("lesson").alias("p")).collect()}
    assert prev == {"T": "L" * 500 + "...", "U": "short"}
    many = spark.range(0, 57).withColumn("ts", (F.col("id") * 7) % 57)
    ranked = lessons.global_rank(many, F.col("ts").desc(), name="n").collect()
    assert sorted((r.n, r.ts) for r in ranked) == [(i + 1, 56 - i) for i in range(57)]


def test_lessons_table_append_and_read(spark, tmp_dir):
    rows = spark.createDataFrame([("T1", "lesson one"), ("", "no topic"), ("T2", "lesson two")],
                                 "topic string, lesson string")
    rows = rows.withColumn("quiz", F.struct(quiz.parse_quiz(F.lit(QUIZ)).alias("quiz")))
    path = tmp_dir + "/lessons"
    rejected = lessons.append_lessons(rows.filter(F.col("topic") != "T2"), path)
    assert [r.lesson for r in rejected.collect()] == ["no topic"]
    import time
    time.sleep(1.1)
    lessons.append_lessons(rows.filter(F.col("topic") == "T2"), path)
    got = lessons.read_lessons(spark, path).collect()
    assert [r.topic for r in got] == ["T2", "T1"]
    assert len(got[0].quiz.quiz) == 5
    listed = lessons.list_lessons(lessons.read_lessons(spark, path)).orderBy("n").collect()
    assert [(r.n, r.topic) for r in listed] == [(1, "T2"), (2, "T1")]


def test_strip_delimiter_option(spark):
    df = spark.createDataFrame([("p1", QUIZ)], "prompt_id string, text string")
    rows = quiz.quiz_questions(df, strip_delimiter=True).orderBy("pos").collect()
    assert [r.correct_answer for r in rows] == ["A) A set", "C", "They scale eigenvectors.", "", "B"]
