"""Periodic runs of words by a sparse diagonal recurrence.

A run of period q is a diagonal of matches "word i equals word i - q": the match
length of lag q at word i is that at word i - 1 plus one, or zero.  A diagonal
that ends after max(12, 2q) - q matches or more is a run, and is emitted there.

Only lags that can still become runs are followed.  Lags below 12 are followed
word by word.  A run of a longer period q in [k, 2k) holds, k = 12, 24, 48, ...,
a repeat of k words at distance q; so at each of these scales a word opens only
the lags to the earlier occurrences of the k words at it, at distances from k
to 2k.  Those are few: occurrences closer than k / 2 lie in one stretch of a
smaller period d and are taken together.

- Lags between two of them are multiples of d; the stretch has period d, so no
  run of the lag comes of it.
- Between two such stretches a diagonal ends with the shorter overlap, unless
  their starts or ends fall together (two lags), or the stretches touch (each
  lag may be a run).

Scales after the first read only words that repeated at the scale before.  The
work is therefore about linear in the text times the number of scales, also for
a text of a single word, and no pair of occurrences is left out that could be a
run.  Texts are handled row by row without a shuffle.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import Ranges, Words, mix, text_slices

LEAST = 12  # words in a run


def planted_period(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) where the rule of the query repeats the p words from word a on to the end."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _dense(words: np.ndarray, row: np.ndarray, least: int) -> Iterator[tuple]:
    """Runs of periods below ``least``: (first word, size, period) arrays."""
    for q in range(1, min(least, len(words))):
        match = np.zeros(len(words) + 1, np.int8)
        match[q:-1] = (words[q:] == words[:-q]) & (row[q:] == row[:-q])
        turns = np.flatnonzero(np.diff(match, prepend=np.int8(0)))
        start, end = turns[0::2], turns[1::2]  # where diagonals begin and end
        done = end - start >= max(least - q, q)
        yield start[done] - q, end[done] - start[done] + q, np.full(done.sum(), q)


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts of items: the owner and the number within it of each item."""
    owner = np.repeat(first, count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def _openings(at: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lags in [k, 2k) that words open, and the places that repeat.

    ``at`` are the places, ``key`` the hash of the k words at each.  Returns
    (place, lag, places whose words occur again).
    """
    order = np.lexsort((at, key))
    at, key = at[order], key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    again = ~new | np.concatenate([~new[1:], [False]])
    at, new = at[again], new[again]
    if not len(at):
        return at, at, at
    gap = np.diff(at, prepend=0)
    head = np.flatnonzero(new | (gap > k // 2))  # stretches of one smaller period
    group = np.cumsum(new)[head]
    size = np.diff(np.append(head, len(at)))
    lo, hi = at[head], at[head + size - 1]
    step = np.where(size > 1, (hi - lo) // np.maximum(size - 1, 1), 0)
    place, lag = [], []
    for back in range(1, len(head)):
        this = np.arange(back, len(head))
        that = this - back
        near = (group[this] == group[that]) & (lo[this] - hi[that] < 2 * k)
        if not near.any():
            break
        this, that = this[near], that[near]
        place += [lo[this], hi[this]]
        lag += [lo[this] - lo[that], hi[this] - hi[that]]
        d = np.maximum(step[this], step[that])
        touch = np.flatnonzero((d > 0) & (lo[this] - hi[that] < k + 2 * d))
        this, that, d = this[touch], that[touch], d[touch]
        least = lo[this] - hi[that]
        t0 = np.maximum(0, -((least - k) // np.maximum(d, 1)))
        t1 = np.minimum(size[this] + size[that] - 2, (2 * k - 1 - least) // np.maximum(d, 1))
        pick, t = _spread(np.arange(len(this)), np.maximum(t1 - t0 + 1, 0))
        t = t + t0[pick]
        in_that = np.minimum(t, size[that][pick] - 1)
        place.append(lo[this][pick] + (t - in_that) * d[pick])
        lag.append(least[pick] + t * d[pick])
    if not place:
        return at[:0], at[:0], at
    place, lag = np.concatenate(place), np.concatenate(lag)
    fits = (lag >= k) & (lag < 2 * k)
    return place[fits], lag[fits], at


def _sparse(words: np.ndarray, row: np.ndarray, row_end: np.ndarray, row_start: np.ndarray,
            least: int) -> Iterator[tuple]:
    """Runs of periods of ``least`` words or more, scale by scale."""
    ranges = Ranges(words)
    salt = (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)
    k, at = least, np.arange(len(words))
    while True:
        at = np.sort(at)
        at = at[at + k <= row_end[at]]
        if not len(at):
            return
        grams = mix((ranges.total[at + k] - ranges.total[at]) * ranges.down[at])
        place, lag, at = _openings(at, mix(grams ^ salt[at]), k)
        if len(place):
            order = np.lexsort((place, lag))
            place, lag = place[order], lag[order]
            # a diagonal goes on while the next word opens the same lag
            first = np.concatenate([[True], (lag[1:] != lag[:-1]) | (place[1:] - place[:-1] > 1)])
            place, lag = place[first], lag[first]
            on = ranges.agree(place, place - lag, row_end[place] - place)
            before = ranges.agree(place, place - lag, place - lag - row_start[place], back=True)
            done = on + before >= lag
            yield (place - before - lag)[done], (on + before + lag)[done], lag[done]
        k *= 2


def _prime_divisors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def find_runs(words: np.ndarray, row: np.ndarray, first: np.ndarray,
              least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of rows of word hashes: (first word, size, period), by first word and period.

    ``row`` is the row of each word, ``first`` the number of words before each row
    (one more entry than rows).
    """
    row_end, row_start = first[1:][row], first[:-1][row]
    found = [*_dense(words, row, least), *_sparse(words, row, row_end, row_start, least)]
    start, size, period = (np.concatenate([f[j] for f in found] or [np.zeros(0, np.int64)]).astype(np.int64)
                           for j in range(3))
    order = np.lexsort((size, period, start))
    start, size, period = start[order], size[order], period[order]
    once = np.ones(len(start), bool)
    once[1:] = (start[1:] != start[:-1]) | (period[1:] != period[:-1])
    start, size, period = start[once], size[once], period[once]
    ranges = Ranges(words)
    least_period = np.ones(len(start), bool)
    for q in np.unique(period).tolist():
        of = np.flatnonzero(period == q)
        for r in _prime_divisors(q):
            d = q // r
            least_period[of] &= ~ranges.same(start[of], start[of] + d, size[of] - d)
    return start[least_period], size[least_period], period[least_period]


def _rows(part: pa.RecordBatch, least: int, plant: bool, with_runs: bool) -> list[tuple]:
    texts = part.column(part.schema.get_field_index("text"))
    ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
    words = Words(texts)
    source = np.arange(len(words.start))
    planted = set()
    for i, doc in enumerate(ids):
        lo, hi = int(words.first[i]), int(words.first[i + 1])
        rule = planted_period(doc, hi - lo) if plant else None
        if rule:
            a, p = lo + rule[0], rule[1]
            source[a:hi] = a + np.arange(hi - a) % p
            planted.add(i)
    start, size, period = find_runs(words.hash[source], words.row, words.first, least)
    edges = np.searchsorted(start, words.first)
    out = []
    for i, text in enumerate(texts.cast(pa.binary()).to_pylist()):
        kept = (text or b"").split()  # the same white space as for words
        lo, n = int(words.first[i]), len(kept)
        if i in planted:
            kept = [kept[j] for j in (source[lo:lo + n] - lo).tolist()]
        of = slice(edges[i], edges[i + 1])
        runs = list(zip((start[of] - lo).tolist(), size[of].tolist(), period[of].tolist()))
        best = (None,) * 4
        if runs:
            s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
            best = (s, length, q, 1000 * length // q)
            step = np.zeros(n + 1, np.int64)
            np.add.at(step, start[of] - lo + period[of], 1)
            np.add.at(step, start[of] - lo + size[of], -1)
            kept = [kept[j] for j in np.flatnonzero(np.cumsum(step[:-1]) <= 0).tolist()]
        body = b" ".join(kept)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        row = (len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(body).hexdigest())
        if with_runs:
            row += ([{"start": s, "length": length, "period": q} for s, length, q in runs],
                    body.decode("utf-8", "replace"))
        out.append(row)
    return out


_OUT = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
        ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
_MORE = [("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
         ("collapsed", pa.string())]


def periodic_runs(docs: DataFrame, least: int = LEAST, plant: bool = False,
                  with_runs: bool = False) -> DataFrame:
    """Find the periodic runs of words of each text, and collapse them to their first period.

    ``docs`` has ``doc_id`` (long) and ``text``; other columns are ignored.  A run
    is a maximal stretch of at least ``least`` words and twice its smallest
    period.  ``plant`` first applies the repeating rule of the query, which
    depends on the ``doc_id``; a row with a null ``doc_id`` keeps its words.  Null
    and empty texts have no words and no runs.  Rows that repeat are returned as
    often as they come; an empty table gives an empty result.  A text is read
    whole by one task.

    Returns doc_id, n_runs, the longest run (start, length, period,
    exponent_milli; ties: smallest start, then period; nulls without runs),
    runs_sha256, collapsed_sha256, and with ``with_runs`` the runs and the
    collapsed text (kept words joined by one space).
    """
    fields = _OUT + (_MORE if with_runs else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                columns = zip(*_rows(part, least, plant, with_runs))
                yield pa.record_batch(
                    [part.column(part.schema.get_field_index("doc_id")),
                     *(pa.array(list(c), t) for c, (_, t) in zip(columns, fields))],
                    ["doc_id", *(name for name, _ in fields)])

    schema = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
              "runs_sha256 string, collapsed_sha256 string")
    if with_runs:
        schema += ", runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
