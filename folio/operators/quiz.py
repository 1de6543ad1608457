"""Quiz parsing: one generated quiz text -> checked, typed questions.

Each quiz is one response row, so parsing is row-local: split at every
``QUESTION:`` (kept), then extract fields with regular expressions.  Java
regexes get ``(?dU)`` so that ``.``, ``$`` and line ends follow Python's
``\\n``-only rules and ``\\s`` covers Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.text import py_strip

# Field patterns.
QUESTION_RE = r"(?sdU)QUESTION:\s*(.*?)(?=OPTIONS:|ANSWER:|$)"
OPTIONS_RE = r"(?sdU)OPTIONS:\s*(.*?)(?=ANSWER:|$)"
ANSWER_RE = r"(?sdU)ANSWER:\s*(.*?)$"
OPTION_RE = r"(?dU)([A-D])\)\s*(.*?)(?=\s+[A-D]\)|$)"

QUESTION_TYPE = "struct<type:string,question:string,options:map<string,string>,correct_answer:string>"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def split_blocks(text) -> Column:
    """``array<string>`` of stripped blocks that start with ``QUESTION:``."""
    blocks = F.transform(F.split(F.coalesce(_c(text), F.lit("")), r"(?=QUESTION:)"), py_strip)
    return F.filter(blocks, lambda b: b.startswith("QUESTION:"))


def _option_map(letters, texts) -> Column:
    """Letters and texts (in match order) -> map; a repeated letter keeps its
    first position and its last text, like a dict update."""
    pairs = F.arrays_zip(letters.alias("l"), texts.alias("t"))
    keys = F.array_distinct(letters)
    values = F.transform(keys, lambda k: py_strip(
        F.element_at(F.filter(pairs, lambda p: p["l"] == k), -1)["t"]))
    return F.map_from_arrays(keys, values)


def option_map(options) -> Column:
    """``A) x B) y`` -> map letter -> text (stripped)."""
    o = _c(options)
    return _option_map(F.regexp_extract_all(o, F.lit(OPTION_RE), 1),
                       F.regexp_extract_all(o, F.lit(OPTION_RE), 2))


def _fields(b) -> Column:
    return F.struct(
        py_strip(F.regexp_extract(b, QUESTION_RE, 1)).alias("question"),
        py_strip(F.regexp_extract(b, OPTIONS_RE, 1)).alias("opts"),
        py_strip(F.regexp_extract(b, ANSWER_RE, 1)).alias("answer"),
        b.contains("ANSWER:").alias("has_answer"),
        b.contains("OPTIONS:").alias("is_mc"))


def _typed(s) -> Column:
    """Extracted fields -> question struct, or null when dropped."""
    mc = F.struct(F.lit("multiple_choice").alias("type"), s["question"].alias("question"),
                  s["options"].alias("options"), s["answer"].alias("correct_answer"))
    oe = F.struct(F.lit("open_ended").alias("type"), s["question"].alias("question"),
                  F.lit(None).cast("map<string,string>").alias("options"),
                  s["answer"].alias("correct_answer"))
    mc_ok = s["has_answer"] & (s["question"] != "") & (F.size(s["options"]) > 0) & (s["answer"] != "")
    return (F.when(s["is_mc"] & mc_ok, mc)
             .when(~s["is_mc"] & s["has_answer"], oe)
             .otherwise(F.lit(None).cast(QUESTION_TYPE)))


def parse_block(block) -> Column:
    """One block -> question struct, or null when the block is dropped."""
    f = _fields(_c(block))
    return _typed(F.struct(f["question"].alias("question"), option_map(f["opts"]).alias("options"),
                           f["answer"].alias("answer"), f["has_answer"].alias("has_answer"),
                           f["is_mc"].alias("is_mc")))


def parse_quiz(text, strip_delimiter: bool = False) -> Column:
    """Quiz text -> ``array<question struct>`` in order (``{"quiz": [...]}``).

    Answers keep the ``|||`` end marker the prompt asks for, as generated;
    ``strip_delimiter`` removes a trailing one.

    Staged ``transform``s: lambdas get no common-subexpression elimination,
    so each stage stores its results in a struct field and later stages only
    read fields; every regular expression runs once per block.
    """
    fields = F.transform(split_blocks(text), _fields)
    if strip_delimiter:
        fields = F.transform(fields, lambda s: s.withField(
            "answer", F.regexp_replace(s["answer"], r"\s*\|\|\|\s*\z", "")))
    matched = F.transform(fields, lambda s: F.struct(
        s["question"].alias("question"), s["answer"].alias("answer"),
        s["has_answer"].alias("has_answer"), s["is_mc"].alias("is_mc"),
        F.regexp_extract_all(s["opts"], F.lit(OPTION_RE), 1).alias("letters"),
        F.regexp_extract_all(s["opts"], F.lit(OPTION_RE), 2).alias("texts")))
    mapped = F.transform(matched, lambda s: F.struct(
        s["question"].alias("question"), s["answer"].alias("answer"),
        s["has_answer"].alias("has_answer"), s["is_mc"].alias("is_mc"),
        _option_map(s["letters"], s["texts"]).alias("options")))
    return F.filter(F.transform(mapped, _typed), lambda q: q.isNotNull())


def quiz_questions(responses: DataFrame, key: str = "prompt_id", text_col: str = "text",
                   strip_delimiter: bool = False) -> DataFrame:
    """One row per kept question: ``key, pos, type, question, options,
    correct_answer``."""
    parsed = parse_quiz(F.col(text_col), strip_delimiter)
    return (responses.select(key, F.posexplode(parsed).alias("pos", "q"))
                     .select(key, F.col("pos").cast("int").alias("pos"), "q.*"))


def quiz_check(quiz) -> Column:
    """Counts by type and whether the asked composition (3 + 1) came back."""
    q = _c(quiz)
    mc = F.size(F.filter(q, lambda x: x["type"] == "multiple_choice"))
    oe = F.size(F.filter(q, lambda x: x["type"] == "open_ended"))
    return F.struct(mc.alias("n_multiple_choice"), oe.alias("n_open_ended"),
                    ((mc == config.QUIZ_MULTIPLE_CHOICE) & (oe == config.QUIZ_OPEN_ENDED)).alias("ok"))
