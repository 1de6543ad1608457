"""Language-model scoring by deleted interpolation.

Tokens are words and one end for each text.  Counts of words, word bigrams and
word trigrams cover the whole training text and may be of any number; what a text
needs of them is brought to it by blocks of documents, cut from the partitions of
the table as they are read, so no text is shuffled.  Each block asks once for each
of its distinct n-grams, counts are summed by n-gram, and the totals go back by
block.  An n-gram has at most one entry for each block, so none is hot.  The
n-grams are sorted hashes, cut into parts by their range and sent as packed
arrays.  A second reading sends the block to its totals as its distinct words and
the rank of each token among them, where it finds its n-grams again.

Below them lies a class n-gram.  Words of at least a share ``frequent`` of the
tokens are classes of their own, all others share one class; words of a share
``common`` serve as the farther context.  So its tables have a size bound
whatever the corpus and all tasks get them.  The probability of a class mixes
trigram, bigram, unigram and uniform estimates; a rare word is drawn from its
class by its own count, mixed with a uniform share for unseen words.

A word's probability mixes its trigram, its bigram and the class estimate.  The
weights depend on a bucket of the context's frequency, and
expectation-maximisation learns them on deleted counts: every training token is
held out in turn (all its counts less one).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import _BASE, SLICE_BYTES, Words, drop_table, mix, stage_table, text_slices, with_end

BLOCK_BYTES = 4 << 20
FREQUENT = 4e-3  # at most 250 classes
COMMON = 2e-2  # at most 50 farther contexts, so at most 3.3 million class trigrams (105 MB)
FOLDS = 5
HELD_OUT = 1
ROUNDS = 20
END = np.uint64(0xC0FFEE1234567891)  # the end token, outside the words
RARE = 0  # class of the words below ``frequent``
START = -1  # context before the first word
BEGIN = np.uint64(0xB5297A4D68E31DA5)  # the same among tokens
CHUNK = 1 << 15  # tokens whose probabilities are taken at once
STRETCHES = 8  # of a part's range, summed one after another
BUCKETS = 128  # of word contexts: 64 by the trigram's, then 64 by the bigram's
SPARE_BITS = 16  # a bigram's or trigram's hash has so many bits more than the corpus has bytes


def fold(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, row of each token): the words of each text and its end."""
    words = Words(texts, lower=True)
    rows = len(words.count)
    row = np.repeat(np.arange(rows), words.count + 1)
    out = np.full(len(row), END, np.uint64)
    inside = np.ones(len(row), bool)
    inside[np.cumsum(words.count + 1) - 1] = False
    out[inside] = words.hash
    return out, row


def hash_bits(size: int) -> int:
    """Bits of the hashes of bigrams and trigrams in ``size`` bytes of text: at most one
    in 2**SPARE_BITS of them equals another's, up to 256 TB."""
    return min(64, max(32, math.ceil(math.log2(size + 1)) + SPARE_BITS))


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes, without the planes above the largest."""
    planes = np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8).T
    used = max(1, 8 - next((k for k in range(8) if planes[7 - k].any()), 8))
    return bytes([used]) + len(values).to_bytes(8, "little") + pa.compress(planes[:used].tobytes(), "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    used, n = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], n * used, "zstd", asbytes=True), np.uint8).reshape(used, n)
    width = next(w for w in (1, 2, 4, 8) if w >= used)  # of the smallest type that holds them
    out = np.zeros((n, width), np.uint8)
    out[:, :used] = planes.T
    return out.view(f"u{width}")[:, 0]


def first_of(row: np.ndarray) -> np.ndarray:
    """Which tokens are the first of their text."""
    return np.concatenate([[True], row[1:] != row[:-1]])


def grams_of(tokens: np.ndarray, row: np.ndarray, bits: int = 64) -> Iterator[np.ndarray]:
    """Hashes of the words, bigrams and trigrams that end at each token; of ``bits`` bits
    but for the words, whose counts are exact."""
    first = first_of(row)
    v = np.concatenate([[BEGIN], tokens[:-1]])
    v[first] = BEGIN
    u = np.concatenate([[BEGIN], v[:-1]])
    u[first] = BEGIN
    yield tokens
    yield mix(v * _BASE + tokens) >> np.uint64(64 - bits)
    yield mix((u * _BASE + v) * _BASE + tokens) >> np.uint64(64 - bits)


_ASKED = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("size", pa.int32()),
                    ("keys", pa.binary()), ("n", pa.binary()), ("docs", pa.binary())])
_ASKED_SQL = "part long, block long, size int, keys binary, n binary, docs binary"


def _rows(rows: list, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _store(docs: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema) as out:
        out.write_table(docs)
    return sink.getvalue().to_pybytes()


def _check(tokens: np.ndarray) -> bytes:
    return zlib.crc32(tokens.tobytes()).to_bytes(4, "little")


def _ask(parts: int, bits: int, block_bytes: int, whole: bool = False):
    """Distinct n-grams of each block, by part, with their number in training texts (size 1
    to 3), and its checksum (size 0) under a part of its own; ``whole``: the block itself."""
    def block_rows(block: int, docs: pa.Table, tokens: np.ndarray) -> Iterator[pa.RecordBatch]:
        if whole:
            u, inv = np.unique(tokens, return_inverse=True)
            rows = [(-1 - block, block, 0, pack(np.diff(u, prepend=np.uint64(0))), pack(inv), _store(docs))]
            yield from _rows(rows, _ASKED).to_batches()
            return
        row = np.repeat(np.arange(docs.num_rows, dtype=np.int32), docs["n_tokens"].to_numpy())
        train = ~docs["held_out"].to_numpy()[row]
        yield from _rows([(-1 - block, block, 0, None, _check(tokens), None)], _ASKED).to_batches()
        for size, keys in enumerate(grams_of(tokens, row, bits), 1):
            u, inv = np.unique(keys, return_inverse=True)
            n = np.bincount(inv, train, len(u)).astype(np.uint64)
            top = u >> np.uint64((64 if size == 1 else bits) - 32)
            part = (top * np.uint64(parts)) >> np.uint64(32)
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            out = [(int(part[lo]), block, size, pack(np.diff(u[lo:hi], prepend=np.uint64(0))), pack(n[lo:hi]), None)
                   for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist())]
            del u, inv, n, top, part
            yield from _rows(out, _ASKED).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        docs, tokens, held = [], [], 0
        for batch in with_end(batches):
            for part in text_slices(batch, limit=min(SLICE_BYTES, block_bytes)) if batch is not None else [None]:
                if part is not None:
                    texts = part.column(part.schema.get_field_index("text"))
                    t, row = tokens_of(texts)
                    count = pa.array(np.bincount(row, minlength=len(texts)).astype(np.int64))
                    docs.append(part.select(["doc_id", "held_out"]).append_column("n_tokens", count))
                    tokens.append(t)
                    held += pa.compute.sum(pa.compute.binary_length(texts)).as_py() or 0
                if docs and (part is None or held >= block_bytes):
                    yield from block_rows(block, pa.Table.from_batches(docs), np.concatenate(tokens))
                    block, docs, tokens, held = block + 1, [], [], 0
                    pa.default_memory_pool().release_unused()
    return run


def _sum_part(table: pa.Table) -> pa.Table:
    """Totals for each block in the order of its n-grams; the words under block -1.  A
    checksum passes as it is."""
    part = table["part"][0].as_py()
    if part < 0:
        return table.select(_ASKED.names).cast(_ASKED)
    sizes = table["size"].to_numpy()
    out = []
    for size in (1, 2, 3):
        at = np.flatnonzero(sizes == size).tolist()
        if not at:
            continue
        keys = [np.cumsum(unpack(table["keys"][i].as_py()), dtype=np.uint64) for i in at]
        counts = [unpack(table["n"][i].as_py()) for i in at]
        low, high = int(min(k[0] for k in keys)), int(max(k[-1] for k in keys))
        # hashes are even over the range, so are its stretches
        edges = np.array([low + (high - low) * j // STRETCHES for j in range(1, STRETCHES)], np.uint64)
        cuts = [[0, *np.searchsorted(k, edges).tolist(), len(k)] for k in keys]
        totals, used, used_n = [[] for _ in keys], [], []
        for j in range(STRETCHES):
            some = [k[c[j]:c[j + 1]] for k, c in zip(keys, cuts)]
            u, inv = np.unique(np.concatenate(some), return_inverse=True)
            total = np.bincount(inv, np.concatenate([n[c[j]:c[j + 1]] for n, c in zip(counts, cuts)]),
                                len(u)).astype(np.uint64)
            done = 0
            for mine, k in zip(totals, some):
                mine.append(total[inv[done:done + len(k)]])
                done += len(k)
            if size == 1:
                used.append(u[total > 0])
                used_n.append(total[total > 0])
        out += [(part, table["block"][i].as_py(), size, None, pack(np.concatenate(mine)), None)
                for i, mine in zip(at, totals)]
        if size == 1 and sum(map(len, used)):
            out.append((part, -1, size, pack(np.diff(np.concatenate(used), prepend=np.uint64(0))),
                        pack(np.concatenate(used_n)), None))
    pa.default_memory_pool().release_unused()
    return _rows(out, _ASKED)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, n in zip(batch.column(0), batch.column(1)):
            u = np.cumsum(unpack(keys.as_py()), dtype=np.uint64)
            yield pa.record_batch([pa.array(u.view(np.int64)),
                                   pa.array(unpack(n.as_py()).astype(np.int64))], ["token", "n"])


def gram_totals(docs: DataFrame, parts: int, bits: int = 64, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Packed totals of the n-grams of the blocks of ``docs`` (doc_id, text, held_out)."""
    asked = docs.select("doc_id", "text", "held_out").mapInArrow(_ask(parts, bits, block_bytes), _ASKED_SQL)
    return stage_table(asked.groupBy("part").applyInArrow(_sum_part, _ASKED_SQL), "counts")


class Block:
    """The documents of a block (doc_id, held_out, n_tokens), its distinct words and their
    counts, and of each token the rank of its word and the counts of its bigram and trigram."""

    def __init__(self, docs: bytes, words: bytes, ranks: bytes, c1: bytes, c2: bytes, c3: bytes):
        self.docs = pa.ipc.open_stream(docs).read_all()
        self.words = np.cumsum(unpack(words), dtype=np.uint64)
        self.ranks = unpack(ranks)
        self.row = np.repeat(np.arange(self.docs.num_rows, dtype=np.int32), self.docs["n_tokens"].to_numpy())
        self.packed = c1, c2, c3

    def train(self) -> np.ndarray:
        """Which tokens are of training texts."""
        return ~self.docs["held_out"].to_numpy()[self.row]

    def counts(self, texts: int) -> tuple[np.ndarray, ...]:
        """Of each token: counts of its trigram, bigram and word, and of the contexts of the
        first two, as c3, n3, c2, n2, c1.

        Each word is followed by another or the end, so a context occurs as often as
        the n-gram that it is; ``texts`` is the number of training texts, the count of a
        beginning.
        """
        c1, c2, c3 = map(unpack, self.packed)
        c1 = c1[self.ranks]
        first = first_of(self.row)
        # of the counts' own small types; a beginning's count may need a larger one
        n2, n3 = (np.where(first, np.min_scalar_type(texts).type(texts),
                           np.concatenate([np.zeros(1, c.dtype), c[:-1]])) for c in (c1, c2))
        return c3, n3, c2, n2, c1


_BLOCK = pa.schema([(c, pa.binary()) for c in ("docs", "words", "ranks", "c1", "c2", "c3")])
_BLOCK_SQL = ", ".join(f"{c} binary" for c in _BLOCK.names)


def _bundle(bits: int):
    """A block with the counts of its words and of each token's bigram and trigram."""
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        docs, words, ranks = (block[c][0].as_py() for c in ("docs", "keys", "n"))
        rows = sorted(zip(*(answers[c].to_pylist() for c in ("size", "part", "n"))))
        block = Block(docs, words, ranks, b"", b"", b"")
        tokens = block.words[block.ranks]
        assert rows[0][2] == _check(tokens), "the table came in another order when it was read again"
        out = []
        for size, keys in enumerate(grams_of(tokens, block.row, bits), 1):
            totals = np.concatenate([unpack(n) for s, _, n in rows if s == size])
            if size > 1:
                u, inv = np.unique(keys, return_inverse=True)
                assert len(totals) == len(u)
                totals = totals[inv]
            out.append(pack(totals))
        return _rows([(docs, words, ranks, *out)], _BLOCK)
    return run


def counted_blocks(docs: DataFrame, totals: DataFrame, bits: int = 64, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A staged table with one row for each block, as ``Block`` takes it."""
    whole = docs.select("doc_id", "text", "held_out").mapInArrow(_ask(1, bits, block_bytes, whole=True), _ASKED_SQL)
    answers = totals.where("block >= 0").select("block", "part", "size", "n")
    return stage_table(whole.groupBy("block").cogroup(answers.groupBy("block"))
                       .applyInArrow(_bundle(bits), _BLOCK_SQL), "blocks")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(*(c[i].as_py() for c in batch.columns))
            pa.default_memory_pool().release_unused()


def mixture(c3, n3, c2, n2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, trigram estimate, bigram estimate)."""
    log = lambda n: np.minimum(1 + 2 * np.log2(np.maximum(n, 1)), 63).astype(np.int64)
    bucket = np.where(n3 > 0, log(n3), 64 + np.where(n2 > 0, log(n2), 0))
    share = lambda c, n: np.where(n > 0, np.maximum(c, 0) / np.maximum(n, 1), 0.0)
    return bucket, share(c3, n3), share(c2, n2)


def fit_mixture(bucket, p, n, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of trigram, bigram and class estimates (columns of ``p``) in each bucket."""
    allowed = np.ones((BUCKETS, 3))
    allowed[64:, 0] = 0  # no context, no estimate
    allowed[64, 1] = 0
    weights = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds if len(n) else 0):
        share = weights[bucket] * p
        share *= (n / share.sum(1))[:, None]
        for k in range(3):
            weights[:, k] = np.bincount(bucket, share[:, k], BUCKETS)
        weights = (weights + 1e-6) * allowed
        weights /= weights.sum(1, keepdims=True)
    return weights


class Classes:
    """Class numbers of tokens; 0 is the rare class."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, total: int, common: float):
        order = np.argsort(tokens)
        self.tokens = tokens[order]
        self.counts = counts[order]
        near = np.arange(1, len(tokens) + 1)
        # the farther context knows the common classes only
        self.far = np.concatenate([[RARE], np.where(self.counts >= common * total, near, RARE)])

    def of(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, at + 1, RARE)


def contexts(classes: Classes, block: Block) -> tuple[np.ndarray, ...]:
    """(farther context, context, class) of each token."""
    w = classes.of(block.words).astype(np.int32)[block.ranks]
    first = first_of(block.row)
    v = np.concatenate([w[:1], w[:-1]])
    v[first] = START
    u = np.concatenate([v[:1], v[:-1]])
    u[first] = START
    far = np.where(u >= 0, classes.far[np.maximum(u, 0)], START).astype(np.int32)
    return far, v, w


def _distinct(u, v, w) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """(distinct class trigrams, the place of each among them)."""
    key, inv = np.unique(((u.astype(np.int64) + 1) << 40) | ((v.astype(np.int64) + 1) << 20) | w, return_inverse=True)
    return ((key >> 40) - 1, ((key >> 20) & 0xFFFFF) - 1, key & 0xFFFFF), inv


def _class_grams(classes: Classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            train, classed = block.train(), contexts(classes, block)
            some, n = [np.zeros(0, np.int64)] * 3, np.zeros(0)
            for k in range(0, len(train), 8 * CHUNK):
                at = slice(k, k + 8 * CHUNK)
                more = [np.concatenate([x, c[at][train[at]]]) for x, c in zip(some, classed)]
                weight = np.concatenate([n, np.ones(len(more[0]) - len(n))])
                some, inv = _distinct(*more)
                n = np.bincount(inv, weight, len(some[0]))
            n = n.astype(np.int64)
            yield pa.record_batch([*map(pa.array, some), pa.array(n)], ["u", "v", "w", "n"])
    return run


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values under sorted keys, 0 where a key is missing."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


class ClassModel:
    """Interpolated class probabilities from the n-gram table."""

    def __init__(self, u, v, w, n, classes: Classes):
        self.classes = classes
        self.size = len(classes.tokens) + 1
        far_v = np.where(v >= 0, classes.far[np.maximum(v, 0)], START)
        self.total = float(n.sum())
        self.tables = [self._sum(k, n) for k in self._keys(u, far_v, v, w)]
        self.weights = np.full((64, 4), 0.25)

    @staticmethod
    def _keys(u, far_v, v, w):
        context3 = ((u + 1) << 40) | ((far_v + 1) << 20)
        context2 = (v + 1) << 20
        return context3 | w, context3, context2 | w, context2, w

    @staticmethod
    def _sum(key, n):
        k, inv = np.unique(key, return_inverse=True)
        return k, np.bincount(inv, n, len(k))

    def estimates(self, u, v, w, deleted: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, estimates of the four orders); ``deleted`` is taken off all counts."""
        far_v = np.where(v >= 0, self.classes.far[np.maximum(v, 0)], START)
        c3, n3, c2, n2, c1 = (_lookup(*t, k) - deleted for t, k in
                              zip(self.tables, self._keys(u, far_v, v, w)))
        out = np.empty((len(w), 4))
        for i, (c, n) in enumerate(((c3, n3), (c2, n2), (c1, np.full(len(w), self.total - deleted)))):
            out[:, i] = np.where(n > 0, np.maximum(c, 0) / np.maximum(n, 1), 0.0)
        out[:, 3] = 1.0 / self.size
        # two buckets for each doubling of the farther context's frequency
        bucket = np.where(n3 > 0, 1 + 2 * np.log2(np.maximum(n3, 1)), 0).astype(np.int64)
        return np.minimum(bucket, 63), out

    def fit(self, u, v, w, n, rounds: int = ROUNDS) -> None:
        """Learn the weights of each bucket on deleted counts."""
        bucket, p = self.estimates(u, v, w, deleted=1)
        for _ in range(rounds):
            share = self.weights[bucket] * p
            share *= (n / share.sum(1))[:, None]
            for k in range(4):
                self.weights[:, k] = np.bincount(bucket, share[:, k], 64)
            self.weights += 1e-6  # buckets without counts fall back to all orders alike
            self.weights /= self.weights.sum(1, keepdims=True)

    def probability(self, u, v, w) -> np.ndarray:
        bucket, p = self.estimates(u, v, w)
        return (self.weights[bucket] * p).sum(1)


def fit_rare(count: np.ndarray, words: np.ndarray, rounds: int = 50) -> tuple[float, float, float]:
    """(weight of the own count, rare tokens, rare words) from counts of counts.

    ``words`` words occur ``count`` times each; deleting a token leaves count - 1.
    """
    total, kinds = float((count * words).sum()), float(words.sum())
    if total < 2:
        return 0.5, max(total, 1.0), kinds
    weight = 0.5
    own = np.maximum(count - 1, 0) / (total - 1)
    for _ in range(rounds):
        share = weight * own / (weight * own + (1 - weight) / (kinds + 1))
        weight = min(max(float((share * count * words).sum()) / total, 1e-6), 1 - 1e-6)
    return weight, total, kinds


def _base(model: ClassModel, rare: tuple, classed: tuple, c1: np.ndarray, deleted: int) -> np.ndarray:
    """Probabilities by the class model; ``deleted`` is taken off all counts."""
    weight, rare_total, rare_kinds = rare
    some, inv = _distinct(*classed)
    bucket, p = model.estimates(*some, deleted=deleted)
    p = (model.weights[bucket] * p).sum(1)[inv]
    own = weight * np.maximum(c1 - deleted, 0) / max(rare_total - deleted, 1) + (1 - weight) / (rare_kinds + 1)
    return np.where(classed[2] == RARE, p * own, p)


def _chunks(block: Block, model: ClassModel, texts: int) -> tuple:
    return (block.counts(texts), contexts(model.classes, block),
            [slice(k, k + CHUNK) for k in range(0, len(block.row), CHUNK)])


def _bins(p: np.ndarray, base: np.ndarray) -> np.ndarray:
    """0 for 0, else one for each halving of the share of ``base``: 64 in all."""
    return np.where(p > 0, np.clip(32 + np.log2(np.maximum(p, 1e-300) / base), 1, 63), 0).astype(np.int64)


def _deleted(model: ClassModel, rare: tuple, texts: int):
    """Estimates of the training tokens on deleted counts, as shares of their sum (a
    common factor does not change what is learned), summed by bucket and bins of their
    ratios: at most 128 * 64 * 64 rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            counts, classed, chunks = _chunks(block, model, texts)
            train = block.train()
            keys, sums = [np.zeros(0, np.int64)], [np.zeros((0, 4))]
            for at in chunks:
                on = train[at]
                c3, n3, c2, n2, c1 = (c[at][on].astype(float) for c in counts)
                bucket, p3, p2 = mixture(c3 - 1, n3 - 1, c2 - 1, n2 - 1)
                p1 = _base(model, rare, tuple(c[at][on] for c in classed), c1, 1)
                keys.append((bucket * 64 + _bins(p3, p1)) * 64 + _bins(p2, p1))
                p = np.stack([np.ones(len(p1)), p3, p2, p1], 1)
                p[:, 1:] /= p[:, 1:].sum(1, keepdims=True)
                sums.append(p)
                k, inv = np.unique(np.concatenate(keys), return_inverse=True)
                every = np.concatenate(sums)
                keys, sums = [k], [np.stack([np.bincount(inv, every[:, j], len(k)) for j in range(4)], 1)]
            yield pa.record_batch([pa.array(keys[0]), *[pa.array(np.ascontiguousarray(c)) for c in sums[0].T]],
                                  ["key", "n", "p3", "p2", "p1"])
    return run


def _score(model: ClassModel, rare: tuple, weights: np.ndarray, texts: int, total: int, kinds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            counts, classed, chunks = _chunks(block, model, texts)
            row, docs = block.row, block.docs
            p = np.zeros(len(row))
            for at in chunks:
                c3, n3, c2, n2, c1 = (c[at].astype(float) for c in counts)
                bucket, p3, p2 = mixture(c3, n3, c2, n2)
                p1 = _base(model, rare, tuple(c[at] for c in classed), c1, 0)
                p[at] = (weights[bucket] * np.stack([p3, p2, p1], 1)).sum(1)
            c = counts[4]
            base = np.log10((c.astype(float) + 0.5) / (total + 0.5 * (kinds + 1)))
            rows = docs.num_rows
            yield from pa.Table.from_arrays(
                [docs["doc_id"], docs["held_out"], docs["n_tokens"],
                 pa.array(np.bincount(row, c > 0, rows).astype(np.int64)),
                 pa.array(np.full(rows, total, np.int64)),
                 pa.array(np.bincount(row, base, rows)),
                 pa.array(np.bincount(row, np.log10(p), rows))], schema=_OUT).combine_chunks().to_batches()
    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                  ("n_known", pa.int64()), ("train_tokens", pa.int64()),
                  ("base_score", pa.float64()), ("score", pa.float64())])
_OUT_SQL = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
            "base_score double, score double")


def lm_scores(docs: DataFrame, frequent: float = FREQUENT, common: float = COMMON,
              block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Log10 probability of every whole text under a model of the training texts.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored.  Training
    texts are those whose crc32(doc_id as text) modulo 5 is not 1; rows with a
    null ``doc_id`` are training texts.  Null, empty and blank texts are one end
    token.  Repeated rows count as often as they occur.  A partition that is read
    again must give its rows in the same order (as a scan does; write other tables
    first), or the job fails by a checksum.  Without any training
    text all counts are zero and the scores are those of the uniform model; an
    empty table gives an empty result.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    docs = docs.select("doc_id", "text", held.alias("held_out"))

    bits = hash_bits(size)
    asked = gram_totals(docs, max(1, math.ceil(size / block_bytes)), bits, block_bytes)
    words = asked.where("block = -1").select("keys", "n").mapInArrow(_words, "token long, n long")
    total, kinds, texts = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("*"),
        F.coalesce(F.sum(F.when(F.col("token") == int(END.view(np.int64)), F.col("n"))), F.lit(0))).first()

    limit = max(1.0, frequent * total)
    top = words.where(F.col("n") >= limit).select("token", "n").collect()  # at most 1/frequent rows
    classes = Classes(np.array([r.token for r in top], np.int64).view(np.uint64),
                      np.array([r.n for r in top], np.int64), total, common)
    # counts of counts: exact up to 1000, then 32 bins for each doubling
    fine = F.when(F.col("n") <= 1000, F.col("n").cast("double")) \
        .otherwise(F.pow(F.lit(2.0), F.round(F.log2("n") * 32) / 32))
    spread = (words.where(F.col("n") < limit).groupBy(fine.alias("count"))
              .agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect())
    rare = fit_rare(np.array([r.tokens / r.words for r in spread], float),
                    np.array([r.words for r in spread], float))
    blocks = counted_blocks(docs, asked, bits, block_bytes)
    drop_table(asked)

    # bounded by the numbers of classes, not by the corpus
    table = (blocks.mapInArrow(_class_grams(classes), "u long, v long, w long, n long")
             .groupBy("u", "v", "w").agg(F.sum("n").alias("n"))).toArrow()
    u, v, w, n = (table[c].to_numpy() for c in ("u", "v", "w", "n"))
    model = ClassModel(u, v, w, n, classes)
    if len(n):
        model.fit(u, v, w, n)
    # a row for each bucket and halving of the ratios, not for each token
    seen = (blocks.mapInArrow(_deleted(model, rare, texts), "key long, n double, p3 double, p2 double, p1 double")
            .groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "p3", "p2", "p1")]).toArrow())
    n = seen["n"].to_numpy()
    p = np.stack([seen[c].to_numpy() / np.maximum(n, 1) for c in ("p3", "p2", "p1")], 1)
    weights = fit_mixture(seen["key"].to_numpy() >> 12, p, n)
    return blocks.mapInArrow(_score(model, rare, weights, texts, total, kinds), _OUT_SQL)
