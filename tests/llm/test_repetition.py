"""Periodic runs, conversation repair and repetition rules against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from folio.llm import turns as turns_module
from folio.llm.periods import find_runs, periodic_runs, planted_period
from folio.llm.repeats import repetition_rules
from folio.llm.turns import backward, damaged, repair_turns, turn_chunks, viterbi

WORD = re.compile(r"[^\x20\x09-\x0D]+")
HASHES = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def runs_truth(w, least=12):
    out, n = [], len(w)
    for q in range(1, n):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s, size = i - q, j - i + q
            if size >= max(least, 2 * q) and not any(
                    all(w[x] == w[x - d] for x in range(s + d, j)) for d in range(1, q)):
                out.append((s, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def odd_words(rng):
    kind, w = rng.random(), []
    if kind < 0.3:
        return [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 90))]
    base = [rng.randrange(2) for _ in range(rng.randint(1, 3))]
    for _ in range(rng.randint(1, 5)):
        if kind < 0.6:
            base = [rng.randrange(rng.choice([2, 3, 40])) for _ in range(rng.randint(1, 30))]
        w += (base * 40)[rng.randint(0, 3):rng.randint(10, 80)]
        if rng.random() < 0.4:
            w.append(rng.randrange(3))
    return w


def test_runs_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        rows = [odd_words(rng) for _ in range(rng.randint(1, 4))]
        first = np.cumsum([0] + [len(r) for r in rows])
        row = np.repeat(np.arange(len(rows)), np.diff(first))
        found = zip(*(x.tolist() for x in find_runs(HASHES[np.array(sum(rows, []), int)], row, first)))
        got = [[] for _ in rows]
        for s, size, q in found:
            r = int(np.searchsorted(first, s, "right")) - 1
            got[r].append((s - int(first[r]), size, q))
        assert got == [runs_truth(r) for r in rows]


def test_runs_of_long_texts_are_linear():
    for w, n in (([0] * 400_000, 1), ([0] * 100_000 + [1] + [0] * 100_000, 2)):
        start, size, period = find_runs(HASHES[np.array(w)], np.zeros(len(w), int), np.array([0, len(w)]))
        assert len(start) == n and set(period.tolist()) == {1}


def runs_row(doc, text):
    w = WORD.findall(text or "")
    rule = planted_period(doc, len(w))
    if rule:
        a, p = rule
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = runs_truth(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    return (doc, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{x}é" + rng.choice(["", "\n", "\t "]) for x in odd_words(rng))) for i in range(150)]
    return rows + [(200, None), (201, ""), (202, " \n "), (None, "a b " * 20), (203, "x " * 5000), (203, "x " * 5000),
                   (204, "    " * 8), (None, None)]


def frame(spark, texts, extra="start long, text_id string, period long, kept boolean"):
    return spark.createDataFrame([(i, t, 1, "x", 2, True) for i, t in texts],
                                 "doc_id long, text string, " + extra).repartition(3)


def test_periodic_runs(spark, texts):
    got = periodic_runs(frame(spark, texts), plant=True).collect()
    assert sorted(map(tuple, got), key=str) == sorted((runs_row(*r) for r in texts), key=str)
    assert periodic_runs(frame(spark, texts).where("false")).count() == 0
    row = periodic_runs(frame(spark, [(7, "a b c " * 5 + "d")]), with_runs=True).first()
    assert [tuple(r) for r in row.runs] == [(0, 15, 3)] and row.collapsed == "a b c d"


def rules_row(doc, text, least=16):
    t = text or ""
    w = WORD.findall(t)
    n, lines = len(w), [x for x in t.split("\n") if WORD.search(x)]

    def windows(k):
        at = defaultdict(list)
        for i in range(n - k + 1):
            at[tuple(w[i:i + k])].append(i)
        return [v for v in at.values() if len(v) > 1]

    def cover(k):
        return len({j for v in windows(k) for i in v for j in range(i, i + k)})
    longest = 0
    while windows(max(longest, 4) + 1):
        longest = max(longest, 4) + 1
    repeated, within = cover(5), cover(least)
    failed = n < 10 or 100 * repeated > 20 * n
    return (doc, n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeated,
            failed, not failed and 100 * within <= 10 * n and longest <= 50, within, longest)


def test_repetition_rules(spark):
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \n\n"), (None, "é # " * 30), (4, "a  b\na  b\n a  b\n"), (4, "a  b\na  b\n a  b\n")]
    for i in range(120):
        w = [rng.choice(["a", "é", "b#", "<"]) + str(rng.randrange(rng.choice([2, 30, 5000])))
             for _ in range(rng.randint(1, 900))]
        for _ in range(rng.randint(0, 2)):
            a = rng.randrange(len(w))
            w[rng.randrange(len(w)):0] = w[a:a + rng.randint(1, 70)]
        rows.append((10 + i, "".join(x + rng.choice([" ", "\n", " \t"]) for x in w)))
    got = repetition_rules(frame(spark, rows)).collect()
    want = [rules_row(*r) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r[7] for r in want} == {True, False} and any(not r[6] and not r[7] for r in want)
    assert repetition_rules(frame(spark, rows).where("false")).count() == 0
    with pytest.raises(ValueError):
        repetition_rules(frame(spark, rows), least=4)


def test_maximal_repeats(spark):
    text = "a b c d e f x a b c d e f y a b c d e z"
    row = repetition_rules(frame(spark, [(1, text)]), least=5, with_repeats=True).first()
    assert [tuple(r) for r in row.repeats] == [(0, 5, 3), (0, 6, 2)] and row.longest_repeat == 6
    assert repetition_rules(frame(spark, [(1, "a " * 100_000)])).first().longest_repeat == 99_999


def damage(rows):
    for conv, turn, role, text in rows:
        rule = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if rule == 1 else re.sub("[.!?]", "", text) if rule == 2 else text
        row = (turn, "user" if rule == 4 else role, text)
        yield conv, [] if rule == 0 else [row, row] if rule == 3 else [row]


NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLE = {"u": "user", "a": "assistant"}


def repair_truth(rows):
    talks, out = defaultdict(list), []
    for conv, more in damage(rows):
        talks[conv] += more
    for conv, talk in talks.items():
        talk.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1], hashlib.md5(v[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in talk:
            bare = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))

        def least(ways, key, way):
            if key not in ways or way[:2] < ways[key][:2]:
                ways[key] = way

        def inserts(ways):
            for _ in range(3):
                for q, (cost, audit, done) in list(ways.items()):
                    least(ways, NEXT[q], (cost + 3, audit + "I", done + [ROLE[NEXT[q]] + ":"]))
            return ways
        ways = {"": (0, "", [])}
        for (_, role, text), fault in zip(talk, faults):
            old, ways = inserts(ways), {}
            for q, (cost, audit, done) in old.items():
                least(ways, q, (cost + 4, audit + "D", done))
                if fault in ("b", "d"):
                    continue
                more, first = cost + 3 * (fault == "t"), role[:1]
                if (first == "s" and q == "") or first == NEXT[q]:
                    least(ways, first, (more, audit + "K", done + [f"{role}:{text}"]))
                least(ways, NEXT[q], (more + 3, audit + "R", done + [f"{ROLE[NEXT[q]]}:{text}"]))
        ways = inserts(ways)
        cost, audit, done = min((ways[q] for q in ("", "a") if q in ways), key=lambda x: x[:2])
        known = [t for t, _, _ in talk if t is not None]
        first = [role[:1] for _, role, _ in talk]
        out.append((conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, faults.count("b"),
                    faults.count("d"), faults.count("t"),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit,
                    sha("\n".join(done))))
    return sorted(out, key=str)


def talks(seed):
    rng, rows = random.Random(seed), []
    pool = ["ok.", "hm", "yes!", "", " \n", "a?  ", None, "é."] + [f"x{k}." for k in range(8)]
    for conv in [None, *range(24)]:
        roles = rng.choice([["user", "assistant"], ["user", "assistant", "system", None, "", "tool"], ["system"]])
        good = rng.random() < 0.4
        for t in range(rng.choice([1, 3, 8, 60])):
            role = ("user", "assistant")[t % 2] if good and rng.random() < 0.95 else rng.choice(roles)
            rows.append((conv, rng.choice([t, t, t, t, None, rng.randrange(5)]), role,
                         f"u{t}." if rng.random() < 0.7 else rng.choice(pool)))
    return rows + [(99, 3, "user", "same.")] * 50  # repeated rows


@pytest.mark.parametrize("size", [1 << 18, 5])
def test_conversation_repair(spark, size):
    rows = talks(size)
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, "
                               "chunk string, codes int").repartition(4)
    assert sorted(map(tuple, repair_turns(damaged(df), size, True).collect()), key=str) == repair_truth(rows)
    assert repair_turns(damaged(df.where("false")), size, True).count() == 0
    if size == 5:
        fixed = repair_turns(damaged(df), size).where("conv_id is not null").orderBy("conv_id", "place").collect()
        by_talk = defaultdict(list)
        for r in fixed:
            by_talk[r.conv_id].append(r)
        whole = {r[0]: r[8] for r in repair_truth(rows)}
        for conv, talk in by_talk.items():
            assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in talk))
            assert [r.place for r in talk] == list(range(len(talk)))
            assert sha("\n".join(f"{r.role}:{r.text}" for r in talk)) == whole[conv]


def test_passes_converge(spark):
    """A hot conversation is cut into chunks; costs meet after a pass or two."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"text {t}.") for t in range(6000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    chunks = turn_chunks(damaged(df), 100)
    state, passes = viterbi(chunks)
    assert chunks.count() > 50 and passes <= 3
    assert max(len(r.codes) for r in chunks.collect()) <= 100


def test_rank_convergence():
    rng = random.Random(2)
    for _ in range(200):
        codes = bytes(rng.choice([1, 2]) if rng.random() < 0.9 else rng.randrange(16) for _ in range(80))
        ends = [tuple(rng.randrange(4) for _ in range(4)) for _ in range(2)]
        (v, c, _), (w, d, _) = (backward(codes, e) for e in ends)
        got, more, met = backward(codes, ends[1], ends[0])
        assert (v, c + more) == (w, d) if met else (got, more) == (w, d)
    assert turns_module.CHUNK >= 1 << 16
