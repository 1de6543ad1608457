"""Best-fit packing by length patterns.

Documents become token pieces of at most ``capacity``.  Only the histogram of
piece lengths (at most ``capacity`` numbers, however large the corpus) is
planned centrally: patterns of a few lengths that fill a sequence exactly are
enumerated, their repeat counts are fitted to the histogram by non-negative
least squares, rounded down, and what is left is packed best fit, largest
length first, again as repeated patterns.  The pieces themselves never leave
the executors: each gets a rank among the pieces of its length, and the plan's
runs of ranks say where it goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import stage_table
from .tokens import token_pieces

CAPACITY = 1024
SALTS = 256
CHOICES = 24


def enumerate_patterns(lengths: np.ndarray, capacity: int, choices: int = CHOICES) -> list[tuple]:
    """Patterns of one to four present lengths that fill ``capacity`` exactly."""
    present = np.zeros(capacity + 1, bool)
    present[lengths] = True
    out = set()
    if present[capacity]:
        out.add((capacity,))
    for a in lengths:
        rest = capacity - int(a)
        if 0 < rest <= a and present[rest]:
            out.add((int(a), rest))
        fitting = lengths[(lengths < rest) & (lengths <= a)]
        if not len(fitting):
            continue
        picks = fitting[np.unique(np.linspace(0, len(fitting) - 1, choices).astype(int))]
        for b in picks:
            c = rest - int(b)
            if 0 < c and present[c]:
                out.add(tuple(sorted((int(a), int(b), c), reverse=True)))
            for d in (c // 2, c // 3, c // 4):
                if d and present[d] and present[c - d]:
                    out.add(tuple(sorted((int(a), int(b), c - d, d), reverse=True)))
    return sorted(out, reverse=True)


def fit_repeats(patterns: list[tuple], histogram: np.ndarray, steps: int = 600) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared misfit to the histogram.

    Accelerated projected gradient steps on the sparse pattern matrix.
    """
    column = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    length = np.concatenate([np.array(p) for p in patterns])
    size = len(histogram)

    def fill(x):
        return np.bincount(length, x[column], size)

    def back(r):
        return np.bincount(column, r[length], len(patterns))

    scale = max(float(histogram.max()), 1.0)
    h = histogram / scale
    x = y = np.zeros(len(patterns))
    t = 1.0
    # a diagonal scaling: a length in many patterns takes shorter steps
    step = 1.0 / np.maximum(back(np.bincount(length, minlength=size).astype(float)), 1.0)
    for _ in range(steps):
        new = np.maximum(0.0, y - step * back(fill(y) - h))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x * scale


def plan_runs(histogram: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, count, first sequence, offset) that place every piece."""
    left = histogram.astype(np.int64).copy()
    used = np.zeros(capacity + 1, np.int64)
    runs, sequences = [], 0

    def place(pattern, repeat):
        nonlocal sequences
        at = 0
        for length in pattern:
            runs.append((length, used[length], repeat, sequences, at))
            used[length] += repeat
            left[length] -= repeat
            at += length
        sequences += repeat

    def most(pattern):
        return min(int(left[v]) // pattern.count(v) for v in set(pattern))

    lengths = np.flatnonzero(left)
    patterns = enumerate_patterns(lengths, capacity) if len(lengths) else []
    if patterns:
        repeats = np.floor(fit_repeats(patterns, left.astype(float))).astype(np.int64)
        for k in np.argsort(-repeats, kind="stable"):
            n = min(int(repeats[k]), most(patterns[k]))
            if n > 0:
                place(patterns[k], n)
    top = capacity
    while True:
        while top > 0 and left[top] == 0:
            top -= 1
        if top == 0:
            break
        pattern, space = [top], capacity - top
        free = left.copy()
        free[top] -= 1
        while space > 0:
            fits = np.flatnonzero(free[: space + 1] > 0)
            if not len(fits):
                break
            if free[space] > 0:
                pick = space
            else:
                mates = fits[free[space - fits] - (fits == space - fits) > 0]  # two that fill it
                pick = int(mates[-1] if len(mates) else fits[-1])
            pattern.append(pick)
            free[pick] -= 1
            space -= pick
        place(pattern, most(pattern))
    return np.array(runs, np.int64).reshape(-1, 5), sequences


def _placed(runs: np.ndarray):
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]
    start = (runs[:, 0] << 44) + runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length = col["length"].to_numpy()
            rank = col["rank"].to_numpy()
            at = np.searchsorted(start, (length << 44) + rank, "right") - 1
            sequence = runs[at, 3] + rank - runs[at, 1] if len(rank) else rank
            offset = runs[at, 4] if len(rank) else rank
            yield pa.record_batch(
                [*(col[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """Place pieces (any rows with a ``length`` between 1 and ``capacity``)."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # at most ``capacity`` rows reach the driver
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row.length] = row.n
    runs, _ = plan_runs(histogram, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    counts = counts.select("length", "salt", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt")
                              .orderBy("doc_id", "piece", "ids_crc32"))
    return (salted.withColumn("own", own).join(counts, ["length", "salt"])
            .select("doc_id", "piece", "start", "length", "ids_crc32",
                    (F.col("before") + F.col("own") - 1).alias("rank"))
            .mapInArrow(_placed(runs), "doc_id long, piece long, start long, length long, "
                                       "ids_crc32 long, sequence_id long, offset long"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None,
                   end_id: int = 2) -> DataFrame:
    """Pack the token pieces of all documents into sequences of ``capacity`` tokens.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored.  A document
    is its tokens and one end token, so null and empty texts are one token.
    Only documents longer than ``capacity`` are cut; the first piece may be
    shorter.  Repeated rows are packed as often as they occur, rows with a null
    ``doc_id`` too; an empty table gives an empty result.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    return pack_pieces(stage_table(token_pieces(docs, path, capacity, end_id), "pieces"), capacity)
