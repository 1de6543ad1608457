"""Toxic spans with a linear-chain conditional random field.

Only whole texts are labelled, so token labels are made first: in the labelled
sample, a token of a toxic text counts as toxic if one of its features (the word
or its beginning) is far more frequent in toxic texts than in others.  The chain
has two states and runs over the tokens of a line.  Forward-backward gives each
token's marginal; the marginals of a text give its score, by a logistic fit on
the sample, and the runs of tokens with a marginal of one half give the
offending offsets.

The model is fitted on a bounded sample of labelled rows (``sample`` toxic
texts and ``clean_sample`` others, none above ``sample_bytes``); all texts are scored whole, in Arrow
functions without a shuffle.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import _VALUES, Words, mix, range_hash, text_slices

SAMPLE = 1000  # toxic texts, and as many others for the chains
CLEAN_SAMPLE = 3000  # other texts for the token labels
SAMPLE_BYTES = 64 << 10
BITS = 18
PREFIXES = (4, 5, 6)  # bytes of a word's beginning that are features, beside the whole word
EVIDENCE = 25.0  # log-likelihood ratio (G squared) that a toxic feature needs
ODDS = 15.0  # how many times more frequent it is in toxic texts
STEPS = 30
FOLDS = 5
SPAN = 0.5
_TRIM = np.zeros(256, bool)
_TRIM[[ord(c) for c in ".,;:!?\"'()[]{}|*"]] = True


def fold(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


class Tokens:
    """Feature numbers and chains of the words of a few texts."""

    def __init__(self, texts: pa.Array):
        words = Words(texts, lower=True)
        self.words = words
        start, end = words.start.copy(), words.end.copy()
        for _ in range(3):  # outer punctuation is not part of the word
            end -= (end - start > 1) & _TRIM[words.data[end - 1]] if len(end) else 0
            start += (end - start > 1) & _TRIM[words.data[np.minimum(start, len(words.data) - 1)]] \
                if len(start) else 0
        self.start, self.end = start, end
        values = _VALUES[True][words.data]
        mask = np.uint64((1 << BITS) - 1)
        columns = [range_hash(values, start, end)]
        for k in PREFIXES:
            cut = np.minimum(start + k, end)
            # a word no longer than the prefix has no beginning apart from itself
            columns.append(range_hash(values, start, cut) + np.uint64(k))
        self.features = np.stack([(c & mask).astype(np.int32) for c in columns], 1)
        breaks = np.flatnonzero(words.data == 0x0A)
        line = np.searchsorted(breaks, words.start)
        new = np.ones(len(words.start), bool)
        if len(new):
            new[1:] = (line[1:] != line[:-1]) | (words.row[1:] != words.row[:-1])
        self.first = np.flatnonzero(new)
        self.length = np.diff(np.concatenate([self.first, [len(new)]]))
        self.row, self.hash, self.text_first = words.row, words.hash, words.first


class Sample:
    """``Tokens`` of many texts, made a slice at a time; keeps what the fit needs."""

    def __init__(self, texts: pa.Array):
        parts, rows, words = [], 0, 0
        for part in text_slices(pa.record_batch([texts], ["text"])):
            t = Tokens(part.column(0))
            parts.append((t.features, t.first + words, t.length, t.row + rows, t.hash,
                          t.text_first[1:] + words))
            rows += part.num_rows
            words += len(t.hash)
        empty = (np.zeros((0, 1 + len(PREFIXES)), np.int32), *[np.zeros(0, np.int64)] * 3,
                 np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.features, self.first, self.length, self.row, self.hash, ends = (
            np.concatenate(c) for c in zip(empty, *parts))
        self.text_first = np.concatenate([[0], ends])


def chain_messages(emission: np.ndarray, first: np.ndarray, length: np.ndarray,
                   t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of all chains, as log odds of state 1.

    ``t[i, j]`` is the weight of going from state i to j.  All chains step
    together, the longest first, so a step works on those still running.
    """
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    ahead, back = emission.copy(), np.zeros(len(emission))
    if not len(first):
        return ahead, back
    running = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
    for step in range(1, int(length[0])):
        at = first[:running[step]] + step
        m = ahead[at - 1]
        ahead[at] += np.logaddexp(m + t[1, 1], t[0, 1]) - np.logaddexp(m + t[1, 0], t[0, 0])
    last = first + length - 1
    for step in range(1, int(length[0])):
        at = last[:running[step]] - step
        m = emission[at + 1] + back[at + 1]
        back[at] = np.logaddexp(t[1, 1] + m, t[1, 0]) - np.logaddexp(t[0, 1] + m, t[0, 0])
    return ahead, back


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


class Field:
    """The conditional random field and the fit of the document score."""

    def __init__(self, weights=None, start=-4.0, transitions=None, document=(0.0, 0.0, 0.0, -4.0)):
        self.weights = np.zeros(1 << BITS, np.float32) if weights is None else weights
        self.start = float(start)
        self.transitions = np.zeros((2, 2)) if transitions is None else transitions
        self.document = np.asarray(document, float)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, weights=self.weights, start=self.start,
                            transitions=self.transitions, document=self.document)
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> "Field":
        with np.load(io.BytesIO(data)) as f:
            return Field(f["weights"], f["start"], f["transitions"], f["document"])

    def emission(self, tokens: Tokens) -> np.ndarray:
        return self.weights[tokens.features].sum(1).astype(float) + self.start

    def odds(self, tokens: Tokens) -> np.ndarray:
        """Log odds of each token's marginal."""
        ahead, back = chain_messages(self.emission(tokens), tokens.first, tokens.length,
                                     self.transitions)
        return ahead + back

    @staticmethod
    def summary(odds: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(largest odds, logs of the number and share of toxic tokens expected) of each text."""
        size = np.diff(first)
        largest, expected = np.full(len(size), -20.0), np.zeros(len(size))
        filled = np.flatnonzero(size)
        if len(filled):
            largest[filled] = np.clip(np.maximum.reduceat(odds, first[filled]), -20, 20)
            p = _sigmoid(odds)
            expected[filled] = np.add.reduceat(np.where(p >= 0.1, p, 0), first[filled])
        return np.stack([largest, np.log1p(expected), np.log((expected + 0.05) / (size + 20))], 1)

    def scores(self, odds: np.ndarray, first: np.ndarray) -> np.ndarray:
        return _sigmoid(self.summary(odds, first) @ self.document[:3] + self.document[3])


def _places_with(tokens: Sample, pick: np.ndarray) -> tuple[np.ndarray, int]:
    """(number of places of each feature, number of places) in the picked texts.

    A place is a pair of neighbouring words, so copies of a text count once.
    """
    h = tokens.hash
    left, right = np.concatenate([h[:1], h[:-1]]), np.concatenate([h[1:], h[-1:]])
    place = mix(left + mix(h + mix(right)))[pick[tokens.row]] << np.uint64(BITS)
    total = np.zeros(1 << BITS)
    for column in tokens.features.T:  # one at a time: less memory
        pairs = np.unique(place | column[pick[tokens.row]].astype(np.uint64))
        total += np.bincount((pairs & np.uint64((1 << BITS) - 1)).astype(np.int64), minlength=1 << BITS)
    return total, max(len(np.unique(place)), 1)


def toxic_features(tokens: Sample, toxic: np.ndarray) -> np.ndarray:
    """Features that occur far more often in toxic texts than chance allows."""
    (k1, n1), (k0, n0) = (_places_with(tokens, toxic == c) for c in (1, 0))

    def part(k, n, share):
        return k * np.log(np.maximum(k, 1e-9) / (n * share)) + \
            (n - k) * np.log(np.maximum(n - k, 1e-9) / (n * (1 - share)))

    share = np.clip((k1 + k0) / (n1 + n0), 1e-9, 1 - 1e-9)
    ratio = 2 * (part(k1, n1, share) + part(k0, n0, share))
    return (ratio >= EVIDENCE) & ((k1 + 0.1) / n1 >= ODDS * (k0 + 0.1) / n0)


def fit_field(texts: pa.Array, toxic: np.ndarray, steps: int = STEPS,
              sample: int = SAMPLE) -> Field:
    """Fit on texts with labels 0 and 1 by gradient ascent on the chains' likelihood.

    All texts decide which features mark toxic tokens; the chains are fitted on
    the toxic ones and the first ``sample`` others.
    """
    rate = float((toxic == 1).mean()) if len(toxic) else 0.0
    prior = float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    tokens = Sample(texts)
    if rate in (0.0, 1.0) or not len(tokens.hash):
        return Field(document=(0.0, 0.0, 0.0, prior))
    marks = toxic_features(tokens, toxic)
    del tokens
    use = (toxic == 1) | (np.cumsum(toxic == 0) <= sample)
    texts, toxic = texts.filter(pa.array(use)), toxic[use]
    tokens = Sample(texts)
    y = ((toxic[tokens.row] == 1) & marks[tokens.features].any(1)).astype(float)
    field = Field(start=np.log((y.sum() + 0.5) / (len(y) + 1)))
    features = tokens.features
    flat, width = features.ravel(), features.shape[1]
    seen = np.bincount(flat, minlength=1 << BITS)
    hits = np.bincount(flat, np.repeat(y, width), 1 << BITS)
    base = (y.sum() + 0.5) / (len(y) + 1)
    # start from the features' own odds, shared among those of a token
    w = np.where(seen > 0, np.log((hits + base) / (seen - hits + 1 - base)) - np.log(base / (1 - base)),
                 0.0) / width
    t = np.zeros((2, 2))
    inner = np.ones(len(y), bool)
    inner[tokens.first] = False
    to = np.flatnonzero(inner)
    pair = np.bincount((2 * y[to - 1] + y[to]).astype(int), minlength=4).astype(float).reshape(2, 2)
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in
             (("w", w), ("t", t), ("b", np.zeros(1)))}

    def ascend(name, value, gradient, rate, step):
        m, s = state[name]
        m[...] = 0.9 * m + 0.1 * gradient
        s[...] = 0.99 * s + 0.01 * gradient * gradient
        return value + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)

    for step in range(1, steps + 1):
        emission = w[features].sum(1) + field.start
        ahead, back = chain_messages(emission, tokens.first, tokens.length, t)
        miss = y - _sigmoid(ahead + back)
        after = emission[to] + back[to]
        logs = np.stack([t[0, 0] + 0 * after, t[0, 1] + after, ahead[to - 1] + t[1, 0],
                         ahead[to - 1] + t[1, 1] + after], 1)
        logs -= logs.max(1, keepdims=True) if len(to) else 0
        joint = np.exp(logs)
        joint /= joint.sum(1, keepdims=True)
        w = ascend("w", w, np.bincount(flat, np.repeat(miss, width), 1 << BITS) - 0.02 * w, 0.1, step)
        t = ascend("t", t, pair - joint.sum(0).reshape(2, 2) - 0.1 * t, 0.1, step)
        field.start = float(ascend("b", np.array([field.start]), np.array([miss.sum()]), 0.1, step)[0])
    field.weights = w.astype(np.float32)
    field.transitions = t
    x = np.c_[Field.summary(field.odds(tokens), tokens.text_first), np.ones(len(toxic))]
    d, ridge = np.array([0.1, 0.1, 0.1, prior]), np.diag([1e-2, 1e-2, 1e-2, 1e-4])
    for _ in range(30):  # Newton steps of the logistic fit
        p = _sigmoid(x @ d)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge
        move = np.linalg.solve(hessian, x.T @ (toxic - p) - ridge @ d)
        d = d + move / max(1.0, np.abs(move).max())
    field.document = d
    return field


def train_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE,
                   clean_sample: int = CLEAN_SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Field:
    """Fit the field on a bounded sample of the labelled texts outside the held-out fold.

    Label rows that are null, neither 0 nor 1, contradictory or without a text
    are left out.  Without texts of both classes the score is the share of toxic
    labels.
    """
    usable = (labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.col("toxic").cast("int").alias("toxic"))
              .where("toxic in (0, 1) and doc_id is not null").where(fold(F.col("doc_id")) != 0)
              .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
              .where("toxic = most").select("doc_id", "toxic"))

    def some(value, n):
        return usable.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id")).limit(n)

    chosen = some(1, sample).union(some(0, clean_sample))  # bounded, so it can be broadcast
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.col("text").cast("string").alias("text"))
             .where(F.octet_length("text") <= sample_bytes)
             .join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]))

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        field = fit_field(table["text"].combine_chunks(), table["toxic"].to_numpy(), sample=sample)
        return pa.table({"model": pa.array([field.to_bytes()], pa.binary())})

    rows = texts.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(fit, "model binary").collect()
    return Field.from_bytes(rows[0].model) if rows else Field()


def _scored(field: Field, keep: list[str], text: str, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in text_slices(batch, text):
                tokens = Tokens(part.column(part.schema.get_field_index(text)))
                odds = field.odds(tokens)
                first = tokens.words.first
                cols = [part.column(part.schema.get_field_index(c)) for c in keep]
                names = [*keep, "score"]
                cols.append(pa.array(field.scores(odds, first)))
                if with_spans:
                    toxic = odds >= np.log(SPAN / (1 - SPAN))
                    spans = [[] for _ in range(part.num_rows)]
                    at = np.flatnonzero(toxic)
                    for i in at.tolist():
                        row = int(tokens.words.row[i])
                        base = int(tokens.words.offsets[row])
                        own = spans[row]
                        s, e = int(tokens.start[i]) - base, int(tokens.end[i]) - base
                        if own and toxic[i - 1] and i - 1 >= first[row]:
                            own[-1]["end"] = e  # goes on from the token before
                        else:
                            own.append({"start": s, "end": e})
                    cols.append(pa.array(spans, kind))
                    names.append("spans")
                yield pa.record_batch(cols, names)
    return run


def score_toxicity(docs: DataFrame, field: Field, keep: list[str] | None = None,
                   with_spans: bool = True) -> DataFrame:
    """The columns ``keep`` (doc_id by default) with ``score`` and ``spans`` of each text.

    Spans are byte ranges of the text in UTF-8.  Null, empty and blank texts have
    no tokens and get the score of a text without toxic tokens.  Every row gives
    one row, in no particular order; an empty table gives an empty result.
    Columns of ``docs`` named ``score`` or ``spans`` cannot be kept.
    """
    keep = ["doc_id"] if keep is None else keep
    if "text" in keep and dict(docs.dtypes)["text"] == "string":  # the text travels once
        text, picked = "text", docs.select(*keep)
    else:
        text, picked = "_text", docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = ", ".join(f"`{c}` {dict(picked.dtypes)[c]}" for c in keep)
    schema += ", score double"
    if with_spans:
        schema += ", spans array<struct<start: bigint, end: bigint>>"
    return picked.mapInArrow(_scored(field, keep, text, with_spans), schema)
