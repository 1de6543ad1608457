"""Conversation structure repair by a parallel Viterbi search with rank convergence.

A conversation is repaired by the cheapest edits (keep, delete, insert, change the
role) that make its roles read "optional system, then user and assistant in
turn".  The search is a shortest path over four states (nothing yet, after the
system turn, after a user turn, after an assistant turn), read from the last turn
to the first: costs of the rest from each state.

Turns are sorted by ranges and cut into chunks, so a conversation of any length is
spread over tasks; a chunk holds one byte a turn.

- Every chunk first starts from a speculative cost vector (no cost in any state);
  the last chunk of a conversation from the true one.
- A fix-up pass gives every chunk the vector its successor came to, less its
  least entry.  The chunk reruns until its vector differs from the earlier run's
  only by a constant; from there on the earlier run is right but for that
  constant.  Passes repeat until no chunk gets another vector.  Costs meet within
  a few turns, as changing state costs at most two inserts, so one or two passes
  do; a pass reads only chunks whose vector is new.  Where costs never meet (a
  stretch of system turns keeps the parity of its length) a pass carries the
  vector one chunk on, so there are at most as many passes as such chunks.
- The constants add up to the cost of the conversation.  With the costs of the
  rest known, the least audit (letters D, I, K, R) is traced forward: in every
  state the first letter that lies on a cheapest path.  A chunk traces from each
  state it can start in; which one holds is known when the chunks are read in
  order, together with the texts.

A SHA-256 of a whole conversation is one chain of its bytes, so the texts of a
conversation are read in order by one task, as a stream sorted by Spark: no more
than one batch is held, plus one byte a turn for the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import drop_table, settle, stage_table

CHUNK = 1 << 18  # turns

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs
START, SYSTEM, USER, ASSISTANT = range(4)  # states
# a turn's code: its role (0 system, 1 user, 2 assistant, 3 other) and 4 x its first fault
SOUND, BLANK, DUPLICATE, CUT = range(4)
_AFTER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # by insert or new role
_LAST = (0, 6, 3, 0)  # costs from each state when no turn is left
_LEGAL = {(0, 1), (1, 2), (2, 1)}  # roles that may follow each other


def _keeps(code: int, state: int) -> int | None:
    """The state after keeping a turn, if that is allowed."""
    role, fault = code % 4, code // 4
    if fault in (BLANK, DUPLICATE):
        return None
    if role == 0:
        return SYSTEM if state == START else None
    return _AFTER[state] if role == _AFTER[state] - 1 else None


def _edits(code: int, rest: tuple, state: int) -> list[tuple[str, int, int]]:
    """The edits of a turn in a state: letter, cost with the rest, next state."""
    out = [("D", DELETE + rest[state], state)]
    extra = TRUNCATED if code // 4 == CUT else 0
    kept = _keeps(code, state)
    if kept is not None:
        out.append(("K", KEEP + extra + rest[kept], kept))
    if code // 4 not in (BLANK, DUPLICATE):
        out.append(("R", REROLE + extra + rest[_AFTER[state]], _AFTER[state]))
    return out


@lru_cache(maxsize=None)
def _step(code: int, rest: tuple) -> tuple[tuple, int]:
    """Costs before a turn from those after it, as (vector with least entry 0, that least)."""
    here = [min(cost for _, cost, _ in _edits(code, rest, q)) for q in range(4)]
    for _ in range(2):  # inserts before the turn
        here = [min(here[q], INSERT + here[_AFTER[q]]) for q in range(4)]
    low = min(here)
    return tuple(c - low for c in here), low


@lru_cache(maxsize=None)
def _trace(code: int, rest: tuple, state: int) -> tuple[str, int]:
    """The least letters of the cheapest edits up to and with a turn, and the state after it."""
    vector, low = _step(code, rest)
    letters = ""
    while True:
        best = [("I", INSERT + low + vector[_AFTER[state]], _AFTER[state]), *_edits(code, rest, state)]
        letter, _, to = min(e for e in best if e[1] == low + vector[state])
        letters, state = letters + letter, to
        if letter != "I":
            return letters, state


def backward(codes: bytes, rest: tuple, old: tuple | None = None) -> tuple[tuple, int, bool]:
    """Run a chunk from its last turn to its first: (vector, constant, whether it met).

    With ``old``, the run from that vector goes along, and the search stops where
    both differ only by a constant: the vector is then that of the old run, and the
    constant the difference from it.
    """
    total = earlier = 0
    for code in reversed(codes):
        if rest == old:
            return rest, total - earlier, True
        rest, low = _step(code, rest)
        total += low
        if old is not None:
            old, low = _step(code, old)
            earlier += low
    return (rest, total, False) if rest != old else (rest, total - earlier, True)


def forward(codes: bytes, rest: tuple, state: int) -> tuple[str, int]:
    """The least audit of a chunk from a state, and the state after it."""
    after = [rest]
    for code in reversed(codes[1:]):
        after.append(_step(code, after[-1])[0])
    letters = []
    for code, then in zip(codes, reversed(after)):
        more, state = _trace(code, then, state)
        letters.append(more)
    return "".join(letters), state


# --- turns as tables -------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of the query's rule: damaged by a checksum of ``conv_id:turn``.

    Dropped rows stay with ``gone`` set, so that no conversation is lost.
    """
    blank = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank),
                      F.coalesce(F.col("turn").cast("string"), blank))
    rule = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    text = F.coalesce(F.col("text").cast("string"), blank)
    return (conversations
            .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                    F.coalesce(F.col("role").cast("string"), blank).alias("role"), text.alias("text"),
                    rule.alias("_rule"))
            .select("conv_id", "turn",
                    F.when(F.col("_rule") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("_rule") <= 1, "").when(F.col("_rule") == 2, F.translate("text", ".!?", ""))
                    .otherwise(F.col("text")).alias("text"),
                    (F.col("_rule") == 0).alias("gone"),
                    F.explode(F.when(F.col("_rule") == 3, F.array(F.lit(0), F.lit(1)))
                              .otherwise(F.array(F.lit(0)))).alias("_copy"))
            .drop("_copy"))


def _code(role: Column, text: Column) -> Column:
    """Role and fault of a turn, duplicates aside."""
    first = F.substring(role, 1, 1)
    kind = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    end = F.substring(F.rtrim(text, F.lit(" \t\n\r\x0b\f")), -1, 1)
    fault = F.when(end == "", BLANK).when(end.isin(".", "!", "?"), SOUND).otherwise(CUT)
    return (kind + 4 * fault).cast("byte")


_CHUNK = [("conv_id", pa.int64()), ("chunk", pa.int64()), ("turn", pa.int64()), ("role", pa.string()),
          ("digest", pa.string()), ("codes", pa.binary())]


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.record_batch([pa.array(list(c), t) for c, (_, t) in zip(columns, fields)],
                           [name for name, _ in fields])


def _pack(size: int):
    """Sorted turns as chunks of at most ``size``: one byte a turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, codes, number, out = None, bytearray(), 0, []

        def close() -> None:
            nonlocal number
            conv, part, *first = head
            out.append((conv, (part << 32) + number, *first, bytes(codes)))
            codes.clear()
            number += 1

        for batch in batches:
            for conv, turn, role, digest, code, first, n, part in zip(*(c.to_pylist() for c in batch.columns)):
                again = code if code // 4 == BLANK else code % 4 + 4 * DUPLICATE
                here = (conv, part, turn, role, digest)
                if head is None:
                    head = here
                if head[0] != conv:
                    close()
                    head = here
                while n:
                    if len(codes) >= size:
                        close()
                        head = here
                    if first:
                        codes.append(code)
                        first, n = False, n - 1
                        continue
                    fill = min(n, size - len(codes))
                    codes.extend(bytes([again]) * fill)
                    n -= fill
                    if len(out) * size >= 1 << 24:
                        yield _batch(out, _CHUNK)
                        out.clear()
            if out:
                yield _batch(out, _CHUNK)
                out.clear()
        if head is not None:
            close()
            yield _batch(out, _CHUNK)
    return run


def turn_chunks(turns: DataFrame, size: int = CHUNK) -> DataFrame:
    """(conv_id, chunk, turn, role, digest, codes): the turns of each conversation in
    order, cut into chunks that follow each other by ``chunk``; turn, role and digest
    are those of the first turn.  Staged.

    Order: turn (nulls first), role, MD5 of the text.  Equal rows are counted
    before they are sorted, and a (role, text) is first at its least turn, so no
    key gathers more than a sorted range.
    """
    key = ["conv_id", "turn", "role", "digest"]
    rows = stage_table(turns.where("not gone")
                       .select("conv_id", "turn", "role", F.md5("text").alias("digest"),
                               _code(F.col("role"), F.col("text")).alias("code"))
                       .groupBy(*key).agg(F.first("code").alias("code"), F.count("*").alias("n")), "turns")
    # the null turn is the least
    firsts = (rows.groupBy("conv_id", "role", "digest")
              .agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))).alias("at"))
              .select(F.col("conv_id").alias("_conv"), F.col("at.turn").alias("_turn"),
                      F.col("role").alias("_role"), F.col("digest").alias("_digest")))
    same = (F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn"))
            & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")))
    marked = rows.join(firsts, same, "left").select(*key, "code", F.col("_role").isNotNull().alias("first"), "n")
    ordered = (marked.repartitionByRange(*key).sortWithinPartitions(*key)
               .withColumn("part", F.spark_partition_id().cast("long")))
    out = stage_table(ordered.mapInArrow(
        _pack(size), "conv_id long, chunk long, turn long, role string, digest string, codes binary"), "chunks")
    drop_table(rows)
    return out


_RUN = "conv_id long, chunk long, used array<int>, vector array<int>, constant long"
_STATE = [("conv_id", pa.int64()), ("chunk", pa.int64()), ("used", pa.list_(pa.int32())),
          ("vector", pa.list_(pa.int32())), ("constant", pa.int64())]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run chunks backward from ``given``; those that ran before stop where they meet."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            given, used = tuple(r["given"]), r["used"]
            vector, constant, met = backward(r["codes"], given, tuple(used) if used is not None else None)
            if met and used is not None:
                vector, constant = r["vector"], r["constant"] + constant
            out.append((r["conv_id"], r["chunk"], list(given), list(vector), constant))
        yield _batch(out, _STATE)


def _vector(values: tuple) -> Column:
    return F.array(*(F.lit(v) for v in values))


def viterbi(chunks: DataFrame) -> tuple[DataFrame, int]:
    """(conv_id, chunk, used, vector, constant, last) of every chunk, staged, and the number of passes.

    ``used`` are the costs after the chunk's last turn, ``vector`` those before its
    first, both less their least entry, and ``constant`` what the chunk adds.
    """
    order = Window.partitionBy("conv_id").orderBy("chunk")  # a row for each chunk, without its codes
    ends = chunks.select("conv_id", "chunk", F.lead("chunk").over(order).isNull().alias("last"))
    start = F.when(F.col("last"), _vector(_LAST)).otherwise(_vector((0, 0, 0, 0)))

    def joined(left: DataFrame) -> DataFrame:
        right = chunks.select(F.col("conv_id").alias("_conv"), F.col("chunk").alias("_chunk"), "codes")
        return left.join(right, F.col("conv_id").eqNullSafe(F.col("_conv"))
                         & (F.col("chunk") == F.col("_chunk"))).drop("_conv", "_chunk")

    none = F.lit(None)
    state = stage_table(joined(ends.withColumn("given", start))
                        .select("conv_id", "chunk", "codes", "given", none.cast("array<int>").alias("used"),
                                none.cast("array<int>").alias("vector"), F.lit(0).cast("long").alias("constant"))
                        .mapInArrow(_run, _RUN), "viterbi")
    passes = 1
    while True:
        given = F.coalesce(F.lead("vector").over(order), _vector(_LAST))
        check = state.withColumn("given", given)
        stale = stage_table(check.where("given <> used"), "stale")
        if stale.isEmpty():
            drop_table(stale)
            return state, passes
        again = joined(stale).select("conv_id", "chunk", "codes", "given", "used", "vector", "constant")
        new = stage_table(check.where("given = used").drop("given").unionByName(again.mapInArrow(_run, _RUN)),
                          "viterbi")
        drop_table(state)
        drop_table(stale)
        state, passes = new, passes + 1


_TRACED = ("conv_id long, chunk long, turn long, role string, digest string, audits array<string>, ends array<int>, "
           "cost long, faults array<long>, illegal long, edges array<int>")
_TRACE = [*_CHUNK[:-1], ("audits", pa.list_(pa.string())), ("ends", pa.list_(pa.int32())), ("cost", pa.int64()),
          ("faults", pa.list_(pa.int64())), ("illegal", pa.int64()), ("edges", pa.list_(pa.int32()))]


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trace chunks forward from every state that they can start in."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            codes, rest = r["codes"], tuple(r["used"])
            states = [START] if r["opens"] else range(4)
            ways = {q: forward(codes, rest, q) for q in states}
            audits = [ways[q][0] if q in ways else None for q in range(4)]
            ends = [ways[q][1] if q in ways else None for q in range(4)]
            cost = r["constant"] + (r["vector"][START] if r["opens"] else 0)
            values = np.frombuffer(codes, np.uint8)
            faults = np.bincount(values // 4, minlength=4)
            roles = values % 4
            pair = roles[:-1] * 4 + roles[1:]
            illegal = len(pair) - int(np.isin(pair, [4 * a + b for a, b in _LEGAL]).sum())
            out.append((r["conv_id"], r["chunk"], r["turn"], r["role"], r["digest"], audits, ends, cost,
                        faults.tolist(), illegal, [int(roles[0]), int(roles[-1])]))
        yield _batch(out, _TRACE)


class _Conversation:
    """One conversation, fed with its chunks and turns in order."""

    def __init__(self, conv_id, digest_only: bool):
        self.conv_id, self.digest_only = conv_id, digest_only
        self.state, self.edge = START, None
        self.queue: list[str] = []  # audits of the turns to come
        self.audit: list[str] = []
        self.place = 0
        self.faults, self.illegal, self.cost = [0] * 4, 0, 0
        self.low = self.high = None
        self.turns = 0
        self.written, self.hash, self.rows = False, hashlib.sha256(), []
        self.role_state = START

    def add_chunk(self, r: dict) -> None:
        audit = r["audits"][self.state]
        self.state = r["ends"][self.state]
        self.queue.append(audit)
        self.audit.append(audit)
        self.faults = [a + b for a, b in zip(self.faults, r["faults"])]
        self.illegal += r["illegal"]
        if self.edge is not None and (self.edge, r["edges"][0]) not in _LEGAL:
            self.illegal += 1
        self.edge = r["edges"][1]
        self.cost += r["cost"]

    def _put(self, role: str, text: str, edit: str) -> None:
        if self.digest_only:
            self.hash.update((("\n" if self.written else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        else:
            self.rows.append((self.conv_id, self.place, role, text, edit))
        self.place += 1
        self.written = True

    def _move(self) -> str:
        self.role_state = _AFTER[self.role_state]
        return "user" if self.role_state == USER else "assistant"

    def add_turn(self, turn, role: str, text: str) -> None:
        if turn is not None:
            if self.high is None or turn != self.high:
                self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        while True:
            letter = self._letter()
            if letter == "I":
                self._put(self._move(), "", "I")
                continue
            if letter == "R":
                self._put(self._move(), text, "R")
            elif letter == "K":
                if role[:1] == "s" and self.role_state == START:
                    self.role_state = SYSTEM
                else:
                    self._move()
                self._put(role, text, "K")
            return

    _at = 0

    def _letter(self) -> str:
        while self._at >= len(self.queue[0]):
            self.queue.pop(0)
            self._at = 0
        self._at += 1
        return self.queue[0][self._at - 1]

    def finish(self) -> tuple:
        tail = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[self.state]
        for _ in tail:
            self._put(self._move(), "", "I")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        _, blank, duplicate, cut = self.faults
        return (self.conv_id, gaps, blank, duplicate, cut, self.illegal, self.cost,
                "".join(self.audit) + tail, self.hash.hexdigest())


_SUMMARY = [("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
            ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
            ("repaired_sha256", pa.string())]
_TURN = [("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()),
         ("edit", pa.string())]
_ROWS = 2000  # rows of a batch given back


def _replay(digest_only: bool):
    """Read chunks and turns of whole conversations in order."""
    fields = _SUMMARY if digest_only else _TURN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        talk, out = None, []

        def close() -> None:
            summary = talk.finish()
            out.extend([summary] if digest_only else talk.rows)

        for batch in batches:
            for r in batch.to_pylist():
                if talk is None or talk.conv_id != r["conv_id"]:
                    if talk is not None:
                        close()
                    talk = _Conversation(r["conv_id"], digest_only)
                if r["kind"] == 0:
                    talk.add_chunk(r)
                elif r["kind"] == 1:
                    talk.add_turn(r["turn"], r["role"], r["text"])
                if not digest_only and len(talk.rows) >= _ROWS:
                    out.extend(talk.rows)
                    talk.rows = []
                if len(out) >= _ROWS:
                    yield _batch(out, fields)
                    out.clear()
        if talk is not None:
            close()
        if out:
            yield _batch(out, fields)
    return run


def repair_turns(turns: DataFrame, size: int = CHUNK, digest_only: bool = False) -> DataFrame:
    """Repair conversations by the cheapest edits, the least audit first.

    ``turns`` has ``conv_id`` (long), ``turn`` (long), ``role``, ``text`` (strings,
    not null) and ``gone`` (rows that are no turns, but name a conversation).  A
    conversation's turns follow by turn (nulls first), then role, then the MD5 of
    the text; equal rows are repeats of each other.  Null conv_ids are one
    conversation.  A blank turn has no visible character, a duplicate equals an
    earlier turn in role and text, a truncated one does not end in ``.``, ``!`` or
    ``?``; only the first fault counts.  An empty table gives an empty result.

    Returns the turns of the repaired conversations (conv_id, place, role, text, edit:
    K kept, R new role, I inserted), or with ``digest_only`` a row for each
    conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.
    """
    settle(turns.sparkSession)
    chunks = turn_chunks(turns, size)
    state, _ = viterbi(chunks)
    right = state.select(F.col("conv_id").alias("_conv"), F.col("chunk").alias("_chunk"), "used", "vector", "constant")
    opens = F.row_number().over(Window.partitionBy("conv_id").orderBy("chunk")) == 1
    known = (chunks.join(right, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk")))
             .select("conv_id", "chunk", "turn", "role", "digest", "used", "vector", "constant", opens.alias("opens")))
    known = known.join(chunks.select(F.col("conv_id").alias("_conv"), F.col("chunk").alias("_chunk"), "codes"),
                       F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk"))
                       ).drop("_conv", "_chunk")
    traced = stage_table(known.mapInArrow(_traces, _TRACED), "traced")
    drop_table(chunks)
    drop_table(state)
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in traced.schema.fields}
    rows = (traced.withColumn("kind", F.lit(0)).withColumn("text", F.lit(None).cast("string"))
            .unionByName(turns.select(
                "conv_id", empty["chunk"], "turn", "role", F.md5("text").alias("digest"),
                *(empty[c] for c in ("audits", "ends", "cost", "faults", "illegal", "edges")),
                F.when(F.col("gone"), 2).otherwise(1).alias("kind"), "text")))
    stream = (rows.repartition("conv_id")
              .sortWithinPartitions("conv_id", "turn", "role", "digest", "kind", "chunk"))
    schema = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
              "audit string, repaired_sha256 string" if digest_only else
              "conv_id long, place long, role string, text string, edit string")
    return stream.mapInArrow(_replay(digest_only), schema)
