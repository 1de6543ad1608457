"""Table functions for Spark SQL: a user's own chunker as ``lateral chunk(...)``."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeResult, udtf

PIECES = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("a", T.IntegerType()),
                       T.StructField("b", T.IntegerType()), T.StructField("text", T.StringType())])


def visible_words(text: str) -> list[str]:
    """Runs of characters other than ASCII white space."""
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def word_spans(text: str, size: int, overlap: int) -> Iterable[tuple[int, int]]:
    """Windows of ``size`` words, ``overlap`` of them shared with the next; the last may be
    shorter and holds at least one word that no other has."""
    n = len(visible_words(text))
    step = max(size - overlap, 1)
    for a in range(0, max(n, 1), step):
        if a and a + overlap >= n:
            return
        yield a, min(a + size, n)


def register_chunker(spark: SparkSession, name: str,
                     spans: Callable[[str, int, int], Iterable[tuple[int, int]]] = word_spans,
                     split: Callable[[str], list[str]] = visible_words) -> None:
    """Make a chunker callable from SQL: ``from docs, lateral name(text, size, overlap)``.

    ``split`` gives the tokens of a text and ``spans`` the windows over them; both run in
    Arrow batches inside tasks.  Each text gives rows (piece, a, b, text), the tokens of a
    window joined by one space; a null text and one without tokens give none.  The
    arguments are checked when the query is planned.
    """
    class Chunks:
        @staticmethod
        def analyze(text, size, overlap) -> AnalyzeResult:
            if not isinstance(text.dataType, (T.StringType, T.NullType)):
                raise ValueError("the first argument must be a string")
            for arg, low in ((size, 1), (overlap, 0)):
                if not arg.isConstantExpression or not isinstance(arg.value, int) or arg.value < low:
                    raise ValueError("size must be a constant of 1 or more, overlap one of 0 or more")
            if overlap.value >= size.value:
                raise ValueError("overlap must be less than size")
            return AnalyzeResult(PIECES)

        def eval(self, text, size, overlap):
            tokens = split(text) if text else []
            if tokens:
                for piece, (a, b) in enumerate(spans(text, size, overlap)):
                    yield piece, a, b, " ".join(tokens[a:b])

    spark.udtf.register(name, udtf(Chunks, useArrow=True))
