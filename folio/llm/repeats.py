"""Quality rules on repetition inside a text, by suffix arrays.

The suffixes of each text are sorted by words.  Neighbours in that order share
the longest common prefixes; an interval of the array whose members share l
words, and whose preceding words differ, is a maximal repeated substring of l
words.  The union of the spans of all those of at least ``least`` words, as a
share of the text, and the longest of them decide.

Only places whose ``seed`` words occur again in their text are sorted: no other
suffix shares that much with a neighbour.  Sorting doubles the compared prefix
and reads only places that are still tied, so ordinary text costs one pass and
a text of a single word a logarithmic number of them.  Texts are handled row by
row without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import Ranges, Words, gram_hash, mix, range_hash, text_slices

SEED = 5  # words of the windows that the base rule counts
LEAST = 16  # words of a repeat that the verdict looks at: longer than a license line
MAX_COVERED = 10  # per cent of the words inside such repeats
MAX_LONGEST = 50  # words of the longest repeat
MIN_WORDS = 10
MAX_REPEATED = 20  # per cent of the words in repeated windows of SEED words

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_BYTES = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64)


def covered(first: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in the spans ``[first, first + size)``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + size, -1)
    return np.cumsum(step[:-1]) > 0


def repeated_windows(words: Words, size: int) -> np.ndarray:
    """The places whose window of ``size`` words occurs more than once in its row."""
    n = len(words.start)
    at = np.flatnonzero(np.arange(n) + size <= words.row_end())
    if not len(at):
        return at
    salt = (words.row[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)
    key = mix(gram_hash(words.hash, size)[at] ^ salt)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return at[again]


class SuffixArray:
    """The sorted suffixes of rows of words that share ``seed`` words with another of their row.

    ``at`` are their places in order, ``lcp[i]`` the words that ``at[i]`` shares
    with ``at[i - 1]`` (0 between rows and where less than ``seed``).
    """

    def __init__(self, words: Words, seed: int = SEED, places: np.ndarray | None = None):
        picked = repeated_windows(words, seed) if places is None else places
        n = len(words.start)
        self.row_end = words.row_end()
        if not len(picked):
            self.at = self.lcp = np.zeros(0, np.int64)
            return
        after = picked + seed
        at = np.union1d(picked, after[after < self.row_end[picked]])
        slot = np.full(n, -1, np.int64)
        slot[at] = np.arange(len(at))
        keys = []
        for j in range(seed):  # words by their hashes; beyond the end comes first
            to = at + j
            inside = to < self.row_end[at]
            keys.append(np.where(inside, words.hash[np.where(inside, to, 0)], np.uint64(0)))
        keys = [words.row[at].astype(np.uint64), *keys]
        order = np.lexsort(keys[::-1])
        new = np.ones(len(at), bool)
        new[1:] = False
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        head = np.flatnonzero(new)
        rank = np.empty(len(at), np.int64)  # the first place of a tie in the order
        rank[order] = np.repeat(head, np.diff(np.append(head, len(at))))
        h = seed
        while True:
            ranked = rank[order]
            head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            size = np.diff(np.append(head, len(order)))
            tied = np.repeat(size > 1, size)
            # places behind the last whole window are no suffixes of interest
            if not tied.any():
                break
            spot = np.flatnonzero(tied)
            who = order[spot]
            to = at[who] + h
            inside = to < self.row_end[at[who]]
            then = np.where(inside, rank[slot[np.where(inside, to, 0)]], -1)
            mine = rank[who]
            again = np.lexsort((then, mine))
            who, then, mine = who[again], then[again], mine[again]
            order[spot] = who
            new = np.concatenate([[True], (mine[1:] != mine[:-1]) | (then[1:] != then[:-1])])
            lead = spot[new]
            rank[who] = np.repeat(lead, np.diff(np.append(np.flatnonzero(new), len(spot))))
            h *= 2
        mark = np.zeros(n, bool)
        mark[picked] = True
        self.at = at[order][mark[at[order]]]
        self.lcp = np.zeros(len(self.at), np.int64)
        a, b = self.at[:-1], self.at[1:]
        limit = np.minimum(self.row_end[a] - a, self.row_end[b] - b)
        limit[words.row[a] != words.row[b]] = 0
        self.lcp[1:] = Ranges(words.hash).agree(a, b, limit)
        self.lcp[self.lcp < seed] = 0

    def longest(self) -> np.ndarray:
        """The words of the longest repeat that starts at each of ``at``."""
        return np.maximum(self.lcp, np.append(self.lcp[1:], 0)) if len(self.at) else self.lcp

    def intervals(self) -> Iterator[tuple[int, int, int]]:
        """The LCP intervals as (words, first, last), the innermost before those around it."""
        stack: list[tuple[int, int]] = []
        for i, l in enumerate([*self.lcp.tolist(), 0]):
            left = i - 1
            while stack and stack[-1][0] > l:
                size, left = stack.pop()
                yield size, left, i - 1
            if l and (not stack or stack[-1][0] < l):
                stack.append((l, left))

    def maximal_repeats(self, words: Words, least: int) -> list[tuple[int, int, int]]:
        """(words, occurrences, first place) of the substrings that occur more than once in a
        row and cannot be made longer at either end in all their occurrences."""
        row_start = words.first[:-1][words.row]
        before = np.where(self.at > row_start[self.at], words.hash[np.maximum(self.at - 1, 0)], np.uint64(0))
        differs = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])]) if len(before) else before
        starts = before == 0
        edge = np.concatenate([[0], np.cumsum(starts)])
        return [(size, b - a + 1, int(self.at[a:b + 1].min())) for size, a, b in self.intervals()
                if size >= least and (differs[b] > differs[a] or edge[b + 1] > edge[a])]


def _line_repeats(data: np.ndarray, words: Words, rows: int) -> np.ndarray:
    """For each row, the lines with a word that equal an earlier line of the row."""
    if not len(words.start):
        return np.zeros(rows, np.int64)
    feeds = np.flatnonzero(data == 0x0A)
    # lines start at rows and behind line feeds
    start = np.unique(np.concatenate([words.offsets[:-1], feeds + 1]))
    start = start[start < len(data)]
    end = np.append(start[1:], len(data))
    fed = data[end - 1] == 0x0A
    end = end - fed
    holds = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[holds], end[holds]
    row = np.searchsorted(words.offsets, start, "right") - 1
    key = range_hash(_BYTES[data], start, end)
    order = np.lexsort((key, row))
    again = (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][1:][again], minlength=rows)


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _measure(part: pa.RecordBatch, least: int, max_covered: int, max_longest: int,
             with_repeats: bool) -> list[pa.Array]:
    words = Words(part.column(part.schema.get_field_index("text")))
    data, rows, n = words.data, part.num_rows, len(words.start)
    inside = covered(words.start, words.end - words.start, len(data))
    chars = _sums(inside & ((data & 0xC0) != 0x80), words.offsets)
    windows = repeated_windows(words, SEED)
    n_repeat = _sums(covered(windows, np.full(len(windows), SEED), n), words.first)
    suffixes = SuffixArray(words, SEED, windows)
    size = suffixes.longest()
    long_ = size >= least
    n_covered = _sums(covered(suffixes.at[long_], size[long_], n), words.first)
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, words.row[suffixes.at], size)
    failed = (words.count < MIN_WORDS) | (100 * n_repeat > MAX_REPEATED * words.count)
    kept = ~failed & (100 * n_covered <= max_covered * words.count) & (longest <= max_longest)
    columns = [words.count, chars, _sums(_SYMBOLS[data], words.offsets),
               _line_repeats(data, words, rows), n_repeat]
    out = [part.column(part.schema.get_field_index("doc_id")),
           *(pa.array(c.astype(np.int64), pa.int64()) for c in columns),
           pa.array(failed), pa.array(kept), pa.array(n_covered.astype(np.int64), pa.int64()),
           pa.array(longest, pa.int64())]
    if with_repeats:
        found: list[list] = [[] for _ in range(rows)]
        for length, count, at in suffixes.maximal_repeats(words, least):
            r = int(words.row[at])
            found[r].append({"start": at - int(words.first[r]), "length": length, "count": count})
        out.append(pa.array([sorted(f, key=lambda x: (x["start"], x["length"])) for f in found], pa.list_(
            pa.struct([("start", pa.int64()), ("length", pa.int64()), ("count", pa.int64())]))))
    return out


_NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
          "kept", "n_covered", "longest_repeat"]
_SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean, n_covered long, longest_repeat long")


def repetition_rules(docs: DataFrame, least: int = LEAST, max_covered: int = MAX_COVERED,
                     max_longest: int = MAX_LONGEST, with_repeats: bool = False) -> DataFrame:
    """Counts of the base rules and the verdict on repeats inside each text.

    ``docs`` has ``doc_id`` (long) and ``text``; other columns are ignored.  A text
    fails the base if it has less than 10 words, or more than 20 % of them lie in
    5-word windows that occur twice.  Of the others those are kept whose maximal
    repeated substrings of at least ``least`` words (5 or more) cover at most
    ``max_covered`` per cent of the words, and whose longest repeat has at most
    ``max_longest`` words.  Words are compared unchanged.

    Null and empty texts have no words and fail.  Rows are judged one by one, also
    those that repeat or lack a ``doc_id``; an empty table gives an empty result.
    A text is read whole by one task.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_covered, longest_repeat, and with ``with_repeats`` the
    maximal repeats (start, length, count).
    """
    if least < SEED:
        raise ValueError(f"least must be {SEED} words or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _NAMES + ["repeats"] * with_repeats
        for batch in batches:
            for part in text_slices(batch):
                yield pa.record_batch(_measure(part, least, max_covered, max_longest, with_repeats), names)

    schema = _SCHEMA + (", repeats array<struct<start: long, length: long, count: long>>" if with_repeats else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
