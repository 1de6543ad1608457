"""Substring dedup by seed and extend.

Texts are joined on winnowed anchors.  An anchor that occurs in several
documents is a seed; each seed is extended both ways to the windows that it
stands for, and windows are compared by their whole word sequence.  Runs of
repeated windows are the maximal repeats of at least ``window`` words.

No pairs of documents are made.  Around each seed the whole reach of the anchor
(all windows that selected it) is compared first, by one grouped minimum; only
seeds that occur in differing surroundings are opened into single windows, and
then only in the first document of each surrounding.  So the work is linear in
the text, whatever the size of a group of copies.

Winnowing: of the ``window - seed + 1`` seeds in a window, the one with the
least hash (the leftmost on ties) is its anchor.  Equal windows therefore have
equal anchors at equal places, so no repeat of ``window`` words is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import (Words, drop_table, gram_hash, long_array, range_hash, stage_table,
                    text_slices)

WINDOW = 13
SEED = 4


class Anchors:
    """Anchors of the texts of a slice.

    ``reach`` hashes all words of the windows that share an anchor, ``lo`` and
    ``hi`` are the first and last of those windows (word indexes), and ``row``
    is the text.
    """

    def __init__(self, words: Words, window: int, seed: int):
        n = len(words.hash)
        self.words = words
        self.window = window
        span = window - seed + 1
        ends = words.row_end()
        starts = np.flatnonzero(np.arange(n) + window <= ends)
        self.windows = starts
        if not len(starts):
            self.at = self.lo = self.hi = self.row = np.zeros(0, np.int64)
            self.seed = self.reach = np.zeros(0, np.uint64)
            self.window_anchor = np.zeros(0, np.int64)
            return
        grams = gram_hash(words.hash, seed)
        m = n - window + 1
        best = grams[:m].copy()
        place = np.zeros(m, np.int64)
        for j in range(1, span):
            other = grams[j:j + m]
            less = other < best
            np.copyto(best, other, where=less)
            place[less] = j
        at = starts + place[starts]
        row = words.row[starts]
        # windows of one anchor follow each other
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
        last = np.concatenate([new[1:], [len(starts)]]) - 1
        self.at, self.lo, self.hi, self.row = at[new], starts[new], starts[last], row[new]
        self.seed = grams[self.at]
        whole = range_hash(words.hash, self.lo, self.hi + window)
        # the same words with the anchor elsewhere are another surrounding
        self.reach = range_hash(np.stack([whole, (self.at - self.lo).astype(np.uint64)], 1).ravel(),
                                np.arange(0, 2 * len(new), 2), np.arange(2, 2 * len(new) + 2, 2))
        self.window_anchor = np.repeat(np.arange(len(new)), last - new + 1)

    def window_hash(self, picked: np.ndarray) -> np.ndarray:
        """Hashes of the windows at word indexes ``picked``."""
        return range_hash(self.words.hash, picked, picked + self.window)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)


def _seeds(window: int, seed: int, with_reach: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                a = Anchors(Words(part.column(part.schema.get_field_index("text"))), window, seed)
                ids = _ids(part).astype(np.int64)[a.row]
                cols = [a.seed.view(np.int64), a.reach.view(np.int64), ids] if with_reach else \
                    [a.seed.view(np.int64), ids]
                if len(ids):  # repeats inside a document count once
                    order = np.lexsort(cols)
                    keep = np.zeros(len(ids), bool)
                    keep[0] = True
                    for c in cols:
                        keep[1:] |= c[order][1:] != c[order][:-1]
                    cols = [c[order][keep] for c in cols]
                names = ["seed", "reach", "doc_id"] if with_reach else ["seed", "doc_id"]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names)
    return run


def _list_of(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    cell = batch.column(batch.schema.get_field_index(name))[i]
    return (cell.values.to_numpy(zero_copy_only=False).view(np.uint64) if cell.is_valid
            else np.zeros(0, np.uint64))


def _open_windows(window: int, seed: int):
    """Windows of the named surroundings of each document: (seed, win, doc_id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                a = Anchors(Words(part.column(part.schema.get_field_index("text"))), window, seed)
                ids = _ids(part).astype(np.int64)
                hits = np.zeros(len(a.at), bool)
                edges = np.searchsorted(a.row, np.arange(part.num_rows + 1))
                for i in range(part.num_rows):
                    lo, hi = edges[i], edges[i + 1]
                    hits[lo:hi] = np.isin(a.reach[lo:hi], _list_of(part, "reaches", i))
                picked = a.windows[hits[a.window_anchor]] if len(a.at) else a.windows
                owner = a.window_anchor[hits[a.window_anchor]] if len(a.at) else a.window_anchor
                yield pa.record_batch([long_array(a.seed[owner]), long_array(a.window_hash(picked)),
                                       pa.array(ids[a.row[owner]], pa.int64())],
                                      ["seed", "win", "doc_id"])
    return run


def _cover(window: int, seed: int, with_text: bool):
    """Remove the words of repeated windows from each text."""
    def plain(part: pa.RecordBatch) -> list[tuple]:
        """Texts that lose nothing."""
        out = []
        for text in part.column(part.schema.get_field_index("text")).cast(pa.binary()).to_pylist():
            words = (text or b"").split()  # the same white space as for words
            out.append((len(words), 0, b" ".join(words)))
        return out

    def marked(part: pa.RecordBatch) -> list[tuple]:
        """Texts with repeated windows."""
        words = Words(part.column(part.schema.get_field_index("text")))
        a = Anchors(words, window, seed)
        edges = np.searchsorted(a.row, np.arange(part.num_rows + 1))
        wedges = np.searchsorted(words.row[a.windows], np.arange(part.num_rows + 1)) \
            if len(a.windows) else np.zeros(part.num_rows + 1, np.int64)
        step = np.zeros(len(words.hash) + 1, np.int64)
        for i in range(part.num_rows):
            whole, single = _list_of(part, "whole", i), _list_of(part, "single", i)
            if len(whole):
                hit = edges[i] + np.flatnonzero(np.isin(a.reach[edges[i]:edges[i + 1]], whole))
                np.add.at(step, a.lo[hit], 1)
                np.add.at(step, a.hi[hit] + window, -1)
            if len(single):
                own = a.windows[wedges[i]:wedges[i + 1]]
                own = own[np.isin(a.window_hash(own), single)]
                np.add.at(step, own, 1)
                np.add.at(step, own + window, -1)
        gone = np.cumsum(step[:-1]) > 0
        data, out = words.data.tobytes(), []
        for i in range(part.num_rows):
            lo, hi = words.first[i], words.first[i + 1]
            left = np.flatnonzero(~gone[lo:hi]) + lo
            kept = [data[s:e] for s, e in zip(words.start[left].tolist(), words.end[left].tolist())]
            out.append((int(hi - lo), int(hi - lo) - len(kept), b" ".join(kept)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
        for batch in batches:
            has = pa.compute.is_valid(batch.column(batch.schema.get_field_index("whole")))
            for texts, rule in ((batch.filter(has), marked), (batch.filter(pa.compute.invert(has)), plain)):
                for part in text_slices(texts):
                    n, removed, kept = zip(*rule(part))
                    cols = [part.column(part.schema.get_field_index("doc_id")), pa.array(n, pa.int64()),
                            pa.array(removed, pa.int64()),
                            pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                    if with_text:
                        cols.append(pa.array([k.decode("utf-8", "replace") for k in kept], pa.string()))
                    yield pa.record_batch(cols, names)
    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED,
                    with_text: bool = False) -> DataFrame:
    """Remove words covered by a window that also starts in an earlier document.

    ``docs`` has ``doc_id`` (long) and ``text``; other columns are ignored.  A
    window is ``window`` consecutive words of one document; it is judged on the
    input.  Null and empty texts have no words and keep nothing; a text shorter
    than a window loses nothing; a passage repeated inside one document only is
    kept; rows with a null ``doc_id`` are returned unchanged and remove nothing.
    Rows that repeat a ``doc_id`` count as one document for the comparison and
    are returned once each.  An empty table gives an empty result.

    Returns doc_id, n_words, n_removed, kept_sha256, and with ``with_text`` the
    kept text (words joined by one space).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    known = docs.where("doc_id is not null")
    shared = (known.mapInArrow(_seeds(window, seed, False), "seed long, doc_id long")
              .groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
              .where("lo < hi").select("seed"))
    found = stage_table(
        known.mapInArrow(_seeds(window, seed, True), "seed long, reach long, doc_id long")
        .join(shared, "seed", "left_semi"), "seeds")
    first = stage_table(found.groupBy("seed", "reach").agg(F.min("doc_id").alias("first")), "reach")
    whole = (found.join(first, ["seed", "reach"]).where("doc_id > first")
             .select("doc_id", "reach"))
    varied = (first.groupBy("seed").agg(F.min("reach").alias("a"), F.max("reach").alias("b"))
              .where("a < b").select("seed"))
    opened = (first.join(varied, "seed", "left_semi")
              .groupBy(F.col("first").alias("doc_id"))
              .agg(F.collect_set("reach").alias("reaches")))
    windows = stage_table(
        known.join(opened, "doc_id")
        .mapInArrow(_open_windows(window, seed), "seed long, win long, doc_id long")
        .distinct(), "windows")
    least = windows.groupBy("seed", "win").agg(F.min("doc_id").alias("first"))
    single = (windows.join(least, ["seed", "win"]).where("doc_id > first")
              .select("doc_id", "win"))
    marks = stage_table(whole.select("doc_id", "reach", F.lit(None).cast("long").alias("win"))
             .unionByName(single.select("doc_id", F.lit(None).cast("long").alias("reach"), "win"))
             .groupBy("doc_id").agg(F.collect_set("reach").alias("whole"),
                                    F.collect_set("win").alias("single")), "marks")
    for done in (found, first, windows):
        drop_table(done)
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return docs.join(marks, "doc_id", "left").mapInArrow(
        _cover(window, seed, with_text), out + (", kept_text string" if with_text else ""))
