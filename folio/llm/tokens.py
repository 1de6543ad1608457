"""Token counts and token ids of whole texts, in Arrow functions.

Texts are cut at boundaries that no token of a byte-level vocabulary crosses:
before a run of white space that follows a visible character.  The library then
encodes the pieces in batches balanced by bytes, each distinct piece once, and
results are kept in a table of bounded size; a text's tokens are those of its
pieces.  Vocabularies whose tokens can cross such boundaries (normalised text,
sentence pieces) are encoded by whole text.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import _SPACE, Words, range_hash, text_slices

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
BATCH_BYTES = 2 << 20
KEPT_PIECES = 1_000_000

# White space of the token pattern that is not ASCII, or that libraries class differently.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
# Bytes that begin such characters in UTF-8.
_ODD_LEAD = np.zeros(256, bool)
_ODD_LEAD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
# Between an ASCII letter and one of these marks a token always ends as well.
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?)"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
LONG_PIECE = 128  # bytes; longer pieces are not kept


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def safe_pieces(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, start, end, row) of pieces whose tokens do not depend on their neighbours.

    A piece is a run of white space and the visible run after it, cut before a
    punctuation mark that follows a letter; white space that ends a text is a
    piece too.  No token of the byte-level pattern holds white space after a
    visible character or a letter and a mark, and nothing before a piece is looked
    at when it is split, so the tokens of a text are those of its pieces.  Texts
    with other white space are one piece.
    """
    words = Words(texts)
    rows = np.arange(len(texts))
    lead = _ODD_LEAD[words.data]
    total = np.concatenate([[0], np.cumsum(lead)])
    odd = total[words.offsets[1:]] > total[words.offsets[:-1]]
    for i in np.flatnonzero(odd):
        odd[i] = _ODD_SPACE.search(texts[int(i)].as_py() or "") is not None
    marks = 1 + np.flatnonzero(_LETTER[words.data[:-1]] & _MARK[words.data[1:]]) \
        if len(words.data) else np.zeros(0, np.int64)
    edge = np.zeros(len(words.data) + 1, bool)
    edge[words.offsets] = True
    marks = marks[~edge[marks]]
    end = np.concatenate([words.end, words.offsets[1:], marks])  # each row's last piece ends it
    row = np.concatenate([words.row, rows, np.searchsorted(words.offsets, marks, "right") - 1])
    order = np.argsort(end, kind="stable")  # rows follow each other, so this sorts by row
    end, row = end[order], row[order]
    start = np.concatenate([[0], end[:-1]])
    new = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    start[new] = words.offsets[:-1]
    keep = (end > start) & ~odd[row]
    whole = np.flatnonzero(odd)
    start = np.concatenate([start[keep], words.offsets[whole]])
    end = np.concatenate([end[keep], words.offsets[whole + 1]])
    row = np.concatenate([row[keep], whole])
    order = np.argsort(row, kind="stable")
    return words, start[order], end[order], row[order]


def byte_batches(texts: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Consecutive texts of about ``limit`` characters together."""
    batch, size = [], 0
    for t in texts:
        batch.append(t)
        size += len(t)
        if size >= limit:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


class Encoder:
    """Token ids of texts by the library that the vocabulary file is for."""

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        self.kept = kept
        self.turn = 0
        # known pieces by sorted hash: place and number of their ids, and when last used
        self.key = np.zeros(0, np.uint64)
        self.place = self.size = self.used = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        if path.endswith(".model"):
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.split = False
            self._encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer
            from tokenizers.pre_tokenizers import ByteLevel
            model = Tokenizer.from_file(path)
            # only the plain byte-level pattern, without normaliser or options, allows cuts
            self.split = (model.normalizer is None and isinstance(model.pre_tokenizer, ByteLevel)
                          and not model.pre_tokenizer.add_prefix_space
                          and not any(re.search(r"\s|[A-Za-z][.,;:!?)]", t.content) or t.lstrip or t.rstrip
                                      or t.single_word
                                      for t in model.get_added_tokens_decoder().values()))
            model.no_padding()
            model.no_truncation()
            self._encode = lambda texts: [e.ids for e in model.encode_batch_fast(
                texts, add_special_tokens=False)]
            if self.split:  # a character of a byte-level token stands for a byte
                self.width = np.zeros(model.get_vocab_size(with_added_tokens=True), np.int64)
                for token, i in model.get_vocab(with_added_tokens=True).items():
                    self.width[i] = len(token)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each), every text by itself."""
        ids = [np.asarray(i, np.uint32) for batch in byte_batches(texts) for i in self._encode(batch)]
        return (np.concatenate([np.zeros(0, np.uint32), *ids]),
                np.array([len(i) for i in ids], np.int64))

    def _new(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple:
        """As ``_whole``; pieces from blank to visible are encoded many at a time."""
        alone = ~_SPACE[data[start]] | _SPACE[data[end - 1]] | (end - start > LONG_PIECE)
        text = data.tobytes()
        pieces = [text[s:e] for s, e in zip(start.tolist(), end.tolist())]
        size = np.zeros(len(pieces), np.int64)
        parts, owner = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        at = np.flatnonzero(alone)
        if len(at):
            ids, n = self._whole([pieces[i].decode() for i in at])
            size[at] = n
            parts.append(ids)
            owner.append(np.repeat(at, n))
        joined = np.flatnonzero(~alone)
        for lo in range(0, len(joined), 4096):
            some = joined[lo:lo + 4096]
            batch = [pieces[i] for i in some]
            ids = np.asarray(self._encode([b"".join(batch).decode()])[0], np.uint32)
            ends = np.cumsum(end[some] - start[some])
            cut = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
            n = np.diff(np.concatenate([[0], cut]))
            size[some] = n
            parts.append(ids)
            owner.append(np.repeat(some, n))
        order = np.argsort(np.concatenate(owner), kind="stable")
        return np.concatenate(parts)[order], size

    def _learn(self, key: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Keep the ids of new pieces (keys sorted); forget those not used lately."""
        if len(self.key) + len(key) > self.kept and len(self.key):
            stay = (self.used > np.median(self.used)) | (self.used == self.turn)
            n = self.size[stay]
            place = np.cumsum(n) - n
            self.ids = self.ids[np.repeat(self.place[stay] - place, n) + np.arange(n.sum())]
            self.key, self.place, self.size, self.used = self.key[stay], place, n, self.used[stay]
        at = np.searchsorted(self.key, key)
        place = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, ids])
        self.key = np.insert(self.key, at, key)
        self.place = np.insert(self.place, at, place)
        self.size = np.insert(self.size, at, size)
        self.used = np.insert(self.used, at, self.turn)

    def _find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(known piece of each piece, row of each piece), after learning new ones."""
        words, start, end, row = safe_pieces(texts)
        h = range_hash(_VALUE[words.data], start, end)
        key, first, which = np.unique(h, return_index=True, return_inverse=True)
        self.turn += 1
        at = np.searchsorted(self.key, key)
        hit = at < len(self.key)
        hit[hit] = self.key[at[hit]] == key[hit]
        if not hit.all():
            self.used[at[hit]] = self.turn  # keeps them while others are forgotten
            new = first[~hit]
            self._learn(key[~hit], *self._new(words.data, start[new], end[new]))
            at = np.searchsorted(self.key, key)
        self.used[at] = self.turn
        return at[which], row

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        if not self.split:
            return self._whole(texts.to_pylist())[1]
        piece, row = self._find(texts)
        return np.bincount(row, self.size[piece], len(texts)).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if not self.split:
            return self._whole(texts.to_pylist())
        piece, row = self._find(texts)
        n = self.size[piece]
        place = self.place[piece] - (np.cumsum(n) - n)
        ids = self.ids[np.repeat(place, n) + np.arange(n.sum())]
        return ids, np.bincount(row, n, len(texts)).astype(np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file, loaded once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part in text_slices(batch, limit=BATCH_BYTES):
                texts = part.column(part.schema.get_field_index("text"))
                yield pa.record_batch(
                    [part.column(part.schema.get_field_index("doc_id")),
                     pc.cast(pc.binary_length(texts), pa.int64()),
                     pa.array(enc.lengths(texts), pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"])
    return run


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Bytes and tokens of each whole text.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored.  No
    beginning, ending or padding tokens are added and nothing is truncated;
    strings of special tokens inside a text are handled as the library does by
    default.  Null and empty texts have no bytes and no tokens.  One row comes
    back for each input row, whatever its ``doc_id``; an empty table gives none.

    Returns doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).
    """
    path = path or vocabulary_path()
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
            .mapInArrow(_counts(path), "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in text_slices(batch, limit=BATCH_BYTES):
                doc_ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
                ids, sizes = enc.encode(part.column(part.schema.get_field_index("text")))
                packed = ids.astype("<u4").tobytes()
                rows, done = [], 0
                for doc_id, n in zip(doc_ids, sizes.tolist()):
                    tokens = packed[4 * done: 4 * (done + n)] + end
                    done += n
                    total = n + 1
                    at = 0
                    # only the first piece may be shorter than the rest
                    size = total % capacity or capacity
                    k = 0
                    while at < total:
                        rows.append((doc_id, k, at, size,
                                     zlib.crc32(memoryview(tokens)[4 * at: 4 * (at + size)])))
                        at, size, k = at + size, capacity, k + 1
                cols = list(zip(*rows)) or [()] * 5
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols],
                                      ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = LIMIT,
                 end_id: int = 2) -> DataFrame:
    """Each text's tokens and one end token, cut into pieces of ``capacity`` if longer."""
    path = path or vocabulary_path()
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
            .mapInArrow(_pieces(path, capacity, end_id),
                        "doc_id long, piece long, start long, length long, ids_crc32 long"))
