"""Property tests: Spark expressions against their Python definitions on
random text (each example is a batch of strings in one DataFrame)."""

import re
import textwrap

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from folio.functions import text as T

ALPHABET = list("abcXYZ019 .,[]") + ["\t", "\n", "\u00a0", "\u3000", "\u2009", "\x1c", "\u0663",
                                      "[12]", "[citation needed]", "[Citation Needed]", "é", "ß"]
texts = st.lists(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join),
                 min_size=20, max_size=40)
SETTINGS = settings(max_examples=6, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


def _clean(t):
    if not t:
        return ""
    t = re.sub(r"\[(?:\d+|citation needed)\]", "", t, flags=re.IGNORECASE)
    t = re.sub("[ \t\u00a0]+", " ", t)
    t = re.sub(r"\n{3,}", "\n\n", t)
    return t.strip()


@SETTINGS
@given(batch=texts)
def test_strip_and_clean_match_python(spark, batch):
    df = spark.createDataFrame([(t,) for t in batch], "t string")
    rows = df.select(T.py_strip("t").alias("s"), T.clean_text("t").alias("c")).collect()
    assert [r.s for r in rows] == [t.strip() for t in batch]
    assert [r.c for r in rows] == [_clean(t) for t in batch]


@SETTINGS
@given(batch=texts, width=st.integers(min_value=5, max_value=30))
def test_preview_matches_textwrap(spark, batch, width):
    df = spark.createDataFrame([(t,) for t in batch], "t string")
    got = [r[0] for r in df.select(T.preview("t", width)).collect()]
    want = [textwrap.shorten(t.replace("\n", " "), width=width, placeholder="…") for t in batch]
    assert got == want
