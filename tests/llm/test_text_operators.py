"""Corpus operators on texts, against plain Python over small dirty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest


from folio.llm._util import Words, connected_components, text_slices
from folio.llm.decontaminate import common_subsequence, find_leaks
from folio.llm.jaccard import CountTree, jaccard_groups, leaf_keys
from folio.llm.lines import line_dedup
from folio.llm.lm import lm_scores
from folio.llm.packing import pack_documents, plan_runs
from folio.llm.substring import substring_dedup
from folio.llm.tokens import Encoder, token_counts, vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# columns that clash with names the operators use inside
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, seed long, block string, "
          "cls string, n string, key string, rank string, score string, salt string, label string")


def words(text):
    return WORD.findall(text or "")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
                    for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = prose(rng, 400)
    cut = base.split(" ")
    near = " ".join(cut[:200] + ["zz"] + cut[201:])
    shared = prose(rng, 60)
    out = [(0, base), (1, base), (2, near), (3, None), (4, ""), (5, " \n\t \x0b"), (6, "one"),
           (7, "ONE"), (8, "one two"), (9, prose(rng, 30) + "\n" + shared + "\n" + prose(rng, 30)),
           (10, shared), (11, prose(rng, 50) + " " + shared), (12, "is the " * 40),
           (13, "is the " * 30), (14, "wörld ünïcode 日本 \u00a0x\u2003y <|endoftext|> end " * 3),
           (15, prose(rng, 30000)), (16, "x" * 100_000), (None, base), (17, base), (17, base),
           (18, "\n".join(["same line", prose(rng, 12)])), (19, "same line \nother"),
           (20, " same line\n\nlast")]
    return [(i, t, None if k % 4 == 3 else "en", None if k % 5 == 4 else f"s{k % 4}", None, 1, *["x"] * 8)
            for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_slices():
    texts = ["a bc\td", None, "", " \x0b", "é\n日本", "x" * 50]
    w = Words(pa.array(texts))
    got = [w.data[s:e].tobytes().decode() for s, e in zip(w.start, w.end)]
    assert got == [x for t in texts for x in words(t)]
    assert w.count.tolist() == [len(words(t)) for t in texts]
    batch = pa.record_batch([pa.array(texts)], ["text"])
    parts = list(text_slices(batch, limit=6))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts and len(parts) > 2
    # the same word hashes alike wherever it stands
    assert Words(pa.array(["x abc"])).hash[1] == Words(pa.array(["abc"])).hash[0]


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)]
    edges += [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in
           connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: root(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def substring_truth(rows):
    first = {}
    for i, t, *_ in rows:
        if i is None:
            continue
        w = words(t)
        for k in range(len(w) - 12):
            g = tuple(w[k:k + 13])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k:k + 13])] < i:
                gone[k:k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring(docs, rows, none):
    got = sorted(map(tuple, substring_dedup(docs).collect()), key=str)
    assert got == substring_truth(rows)
    assert substring_dedup(none).count() == 0


def test_substring_random(spark):
    rng = random.Random(11)
    bank = [prose(rng, rng.randint(5, 40)) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(bank) if rng.random() < .5 else prose(rng, rng.randint(1, 20))
                         for _ in range(rng.randint(0, 8)))) for i in range(60)]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True)
    assert sorted(map(tuple, got.drop("kept_text").collect()), key=str) == substring_truth(rows)
    for r in got.collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def shingles(text):
    w = words((text or "").translate(LOWER))
    if 0 < len(w) < 3:
        return {tuple(w)}
    return {tuple(w[k:k + 3]) for k in range(len(w) - 2)}


def jaccard_truth(rows, percent=90):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets[i] = shingles(t)
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                n = len(sets[x] & sets[y])
                if 100 * n >= percent * (len(sets[x]) + len(sets[y]) - n):
                    a, b = root(x), root(y)
                    up[max(a, b)] = min(a, b)
    return sorted([(i, len(shingles(t)), None if i is None else root(i)) for i, t, *_ in rows], key=str)


def test_jaccard(docs, rows, none):
    assert sorted(map(tuple, jaccard_groups(docs).collect()), key=str) == jaccard_truth(rows)
    assert jaccard_groups(none).count() == 0
    with pytest.raises(ValueError):
        jaccard_groups(docs, percent=50)


@pytest.mark.parametrize("percent", [90, 80])
def test_jaccard_chains(spark, percent):
    """Chains of edits: most of a group is not linked to its smallest member; tiny tiles."""
    rng = random.Random(17)
    rows = []
    for size in (8, 12, 25, 60, 200):
        text = prose(rng, size).split(" ")
        for _ in range(22):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for _ in range(max(1, size // 60)):
                text[rng.randrange(len(text))] = prose(rng, 1)
    got = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"),
                         percent=percent, tile=4)
    assert sorted(map(tuple, got.collect()), key=str) == jaccard_truth(rows, percent)


def test_leaf_keys_meet():
    """Linked sets always share a leaf, small and large, with empty blocks too."""
    rng = np.random.default_rng(2)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        common = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        drop = int(rng.integers(0, n // 10 + 1))
        more = rng.integers(0, 1 << 64, max(0, n // 9 - drop), dtype=np.uint64)
        a, b = np.unique(common), np.unique(np.concatenate([common[drop:], more]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both):
            (x, x_needs), (y, y_needs) = leaf_keys(a, 90), leaf_keys(b, 90)
            shared = np.intersect1d(x, y)
            enough = [p for p, k in x_needs if (shared % np.uint64(64) == p).sum() >= max(k, 1)]
            assert any((shared % np.uint64(64) == p).sum() >= max(k, 1) for p, k in y_needs if p in enough)


def test_jaccard_of_repeated_rows(spark):
    """Rows that occur often are one point: seconds, not hours."""
    rng = random.Random(5)
    base = prose(rng, 120).split(" ")
    near = base[:50] + ["other"] + base[51:]
    rows = [(1, " ".join(base))] * 300 + [(2, " ".join(near))] * 300 + [(2, prose(rng, 50))] * 3
    got = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(1, 1), (2, 1), (2, 2)}


def test_count_tree():
    rng = np.random.default_rng(4)
    counts = rng.poisson(3, (300, 16))
    sizes = counts.sum(1)
    tree = CountTree(counts, sizes)
    for q in range(40):
        overlap = np.minimum(counts, counts[q]).sum(1)
        want = np.flatnonzero(180 * overlap >= 80 * (sizes + sizes[q]))
        assert sorted(tree.search(counts[q], int(sizes[q]), 80).tolist()) == want.tolist()


def line_truth(rows, limit):
    sites, first = collections.defaultdict(set), {}
    for i, t, _, s, *_ in rows:
        for line in (t or "").split("\n") if t is not None else []:
            b = line.strip(" \t\r\x0b\f")
            if b:
                if s is not None:
                    sites[b].add(s)
                if i is not None:
                    first[b] = min(first.get(b, i), i)
    out = []
    for i, t, *_ in rows:
        if t is None:
            out.append((i, 0, 0, None))
            continue
        kept, n = [], 0
        for line in t.split("\n"):
            b = line.strip(" \t\r\x0b\f")
            if b and i is not None and len(sites[b]) >= limit and i > first[b]:
                n += 1
            else:
                kept.append(line)
        out.append((i, len(t.split("\n")), n, "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("margin", [0.25, 0.9])
def test_lines(docs, rows, none, margin):
    got = line_dedup(docs, min_sites=2, margin=margin)
    assert sorted(map(tuple, got.collect()), key=str) == line_truth(rows, 2)
    assert sum(r[2] for r in line_truth(rows, 2)) > 0
    assert line_dedup(none).count() == 0
    assert line_dedup(docs, keep=["lang", "rank"]).columns == \
        ["lang", "rank", "doc_id", "n_lines", "n_removed", "text"]


def ids_of(path):
    if path.endswith(".model"):
        import sentencepiece
        return sentencepiece.SentencePieceProcessor(model_file=path).encode
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(docs, rows, none, name):
    encode = ids_of(vocabulary_path(name))
    got = sorted(map(tuple, token_counts(docs, vocabulary_path(name)).collect()), key=str)
    count = {t: len(encode(t or "")) for _, t, *_ in rows}
    assert got == sorted([(i, len((t or "").encode()), count[t], count[t] > 1024)
                          for i, t, *_ in rows], key=str)
    assert token_counts(none).count() == 0


def test_tokens_at_boundaries():
    encode = ids_of(vocabulary_path())
    rng = random.Random(8)
    bits = [" ", "  ", "\n", "\n\n", "\t", "a", "b's", "é", "12", "!?", "\u00a0", "<|endoftext|>",
            "\x1c", "\x85", "\u200b", "日本", " 'll", "\r\n", "\x0b", "\u0301", "½", "\u2009", "a.", "Z,", "...", ")"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    enc = Encoder(vocabulary_path(), kept=300)  # forgets often
    for lo in range(0, len(texts), 250):
        some = texts[lo:lo + 250]
        ids, n = enc.encode(pa.array(some))
        assert ids.tolist() == [i for t in some for i in encode(t)]
        assert n.tolist() == [len(encode(t)) for t in some] == enc.lengths(pa.array(some)).tolist()


def test_packing(docs, rows, none):
    encode = ids_of(vocabulary_path())
    got = pack_documents(docs).collect()
    pieces = collections.Counter()
    for i, t, *_ in rows:
        ids = np.array(encode(t or "") + [2], "<u4")
        at, k, size = 0, 0, len(ids) % 1024 or 1024
        while at < len(ids):
            pieces[i, k, at, size, zlib.crc32(ids[at:at + size].tobytes())] += 1
            at, k, size = at + size, k + 1, 1024
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    assert pack_documents(none).count() == 0


def test_plan():
    rng = np.random.default_rng(1)
    for lengths, slack in ((np.minimum(1024, rng.lognormal(6, 1, 20000).astype(int) + 1), 1.002),
                           (rng.integers(500, 700, 3000), 1.7), (np.full(1000, 340), 1.01),
                           (np.array([1] * 5), 1.01), (np.array([], int), 1.0)):
        h = np.bincount(lengths, minlength=1025)
        runs, n = plan_runs(h, 1024)
        placed, filled = np.zeros(1025, int), np.zeros(n, int)
        for length, rank, count, sequence, offset in runs:
            assert rank == placed[length]
            placed[length] += count
            filled[sequence:sequence + count] += length
        assert (placed == h).all() and (n == 0 or filled.max() <= 1024)
        assert n <= -(-int(lengths.sum()) // 1024) * slack + 1


def test_lm_scores(docs, rows, none):
    got = lm_scores(docs, block_bytes=100_000).collect()
    counts, held = collections.Counter(), {}
    for i, t, *_ in rows:
        held[i] = i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        if not held[i]:
            counts.update(words((t or "").translate(LOWER)))
            counts[None] += 1
    total, kinds = sum(counts.values()), len(counts)
    want = collections.defaultdict(list)
    for i, t, *_ in rows:
        w = words((t or "").translate(LOWER)) + [None]
        base = sum(np.log10((counts[x] + .5) / (total + .5 * (kinds + 1))) for x in w)
        want[i].append((held[i], len(w), sum(counts[x] > 0 for x in w), total, base))
    assert len(got) == len(rows)
    for r in got:
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == x[:4]
                   and abs(r.base_score - x[4]) < 1e-6 * abs(x[4]) for x in want[r.doc_id])
        assert np.isfinite(r.score) and r.score < 0
    assert lm_scores(none).count() == 0


def test_lm_is_a_distribution_that_beats_the_base(spark):
    from folio.llm.lm import RARE, START, ClassModel, Classes, fit_rare

    rng = np.random.default_rng(0)
    n = 6
    classes = Classes(np.arange(10, 10 + n - 1, dtype=np.uint64), np.array([50, 40, 5, 5, 5]), 200, 0.1)
    u, v, w = (rng.integers(-1, n, 500) for _ in range(3))
    w = np.maximum(w, 0)
    u = np.where(u >= 0, classes.far[np.maximum(u, 0)], START)
    model = ClassModel(u, v, w, rng.integers(1, 9, 500), classes)
    model.fit(u, v, w, np.ones(500))
    for a, b in ((START, START), (0, 3), (1, 2), (2, 5), (START, 1)):
        p = model.probability(np.full(n, a), np.full(n, b), np.arange(n))
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()
    weight, total, kinds = fit_rare(np.array([1., 2., 7.]), np.array([5., 3., 1.]))
    assert abs(weight * (5 + 6 + 7) / total + (1 - weight) * (kinds + 1) / (kinds + 1) - 1) < 1e-9
    assert RARE == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = [r for r in lm_scores(docs).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(60):
        a = [rng.randint(0, 5) for _ in range(rng.randint(0, 90))]
        b = [rng.randint(0, 5) for _ in range(rng.randint(0, 40))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert common_subsequence(np.array(a), np.array(b)) == t[-1][-1]


def test_leaks(spark, docs, rows, none):
    rng = random.Random(21)

    def text(n):
        return " ".join("".join(rng.choice("abcdefghiklmnop") for _ in range(rng.randint(3, 7)))
                        for _ in range(n))
    items = [(k, text(rng.randint(15, 60))) for k in range(8)]
    extra = [(90, None), (91, ""), (92, "  "), (None, text(20)), (3, items[3][1])]
    plain = [(100 + k, text(rng.randint(1, 300))) for k in range(40)]
    copies, changed = [], []
    for k, t in items:
        w = t.split(" ")
        copies.append((1000 + k, text(20) + ", " + t.upper() + ". " + text(30)))
        w = [x if j % 7 != 3 else "zzzz" for j, x in enumerate(w)]
        changed.append((2000 + k, text(25) + " " + " ".join(w) + " " + text(9)))
    table = plain + copies + changed + [(5000, None), (5001, ""), (None, items[0][1])]
    bench = spark.createDataFrame(items + extra, "item_id long, text string")
    got = find_leaks(spark.createDataFrame(table, "doc_id long, text string"), bench)
    pairs = {(r.doc_id, r.item_id) for r in got.collect()}
    assert pairs == {(1000 + k, k) for k, _ in items} | {(2000 + k, k) for k, _ in items}
    blocks = find_leaks(spark.createDataFrame(table, "doc_id long, text string"), bench, block_items=3)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == pairs
    assert find_leaks(none, bench).count() == 0
    assert find_leaks(docs, bench.where("false")).count() == 0
    assert find_leaks(docs, bench).count() == 0


def test_leaks_in_copies(spark):
    """A third of the rows are copies of one short text that holds an item."""
    rng = random.Random(5)

    def text(n):
        return " ".join("".join(rng.choice("abcdefghiklmnop") for _ in range(rng.randint(3, 7)))
                        for _ in range(n))
    items = [(k, text(rng.randint(15, 40))) for k in range(6)]
    hot = text(6) + " " + items[0][1] + " " + text(9)
    table = [(k, hot) for k in range(100)] + [(100 + k, text(rng.randint(20, 80))) for k in range(200)]
    table += [(1000 + k, text(31) + " " + t + " " + text(18)) for k, t in items]
    got = find_leaks(spark.createDataFrame(table, "doc_id long, text string"),
                     spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == \
        {(k, 0) for k in range(100)} | {(1000 + k, k) for k, _ in items}


def test_short_leaks(spark):
    """Verbatim items of 1 to 14 words at every offset between words that no item has."""
    rng = random.Random(8)

    def text(n):
        return " ".join("".join(rng.choice("abcdefghiklmnop") for _ in range(rng.randint(5, 9)))
                        for _ in range(n))
    items = [(k, text(k)) for k in range(1, 15)] + [(20, text(40))]
    table = [(k * 100 + at, f"{text(at)} {t} {text(17 - at)}") for k, t in items for at in range(18)]
    table += [(9000 + k, t) for k, t in items]
    got = find_leaks(spark.createDataFrame(table, "doc_id long, text string"),
                     spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == \
        {(k * 100 + at, k) for k, _ in items for at in range(18)} | {(9000 + k, k) for k, _ in items}


def test_lm_gram_counts(docs, rows):
    """Totals of all words, bigrams and trigrams that come to the blocks, against plain counts."""
    from folio.llm.lm import Block, counted_blocks, gram_totals
    texts = [(t or "").translate(LOWER) for _, t, *_ in rows]
    held = [k % 5 == 1 for k in range(len(texts))]
    counts = [collections.Counter() for _ in range(4)]
    for t, h in zip(texts, held):
        w = [0, 0, *words(t), None]
        if not h:
            for size in (1, 2, 3):
                counts[size].update(tuple(w[k - size + 1:k + 1]) for k in range(2, len(w)))
    n_texts = len(held) - sum(held)
    table = pa.table({"doc_id": range(len(texts)), "text": texts, "held_out": held})
    frame = docs.sparkSession.createDataFrame(table.to_pandas()).repartition(2)
    for bits in (64, 48):
        blocks = [Block(*r) for r in counted_blocks(
            frame, gram_totals(frame, 4, bits, 50_000), bits, 50_000).collect()]
        assert len(blocks) >= 3
        assert sorted(i for b in blocks for i in b.docs["doc_id"].to_pylist()) == list(range(len(texts)))
        for block in blocks:
            c3, n3, c2, n2, c1 = block.counts(n_texts)
            at = 0
            for i in block.docs["doc_id"].to_pylist():
                w = [0, 0, *words(texts[i]), None]
                for k in range(2, len(w)):
                    assert (c3[at], c2[at], c1[at]) == tuple(counts[s][tuple(w[k - s + 1:k + 1])] for s in (3, 2, 1))
                    assert n2[at] == (n_texts if k == 2 else counts[1][w[k - 1],])
                    assert n3[at] == (n_texts if k == 2 else counts[2][tuple(w[k - 2:k])])
                    at += 1
            assert at == len(block.row)


def test_lm_uses_grams_of_rare_words(spark):
    """Pairs of words far below the share of a class are evidence; order and partner count."""
    rng = random.Random(4)
    pairs = [(f"left{k}", f"right{k}") for k in range(300)]
    rows = [(k, " ".join(f"{a} {b} and" for a, b in rng.sample(pairs, 20))) for k in range(400)]
    free = [k for k in range(1000, 3000) if zlib.crc32(str(k).encode()) % 5 == 1]
    good, bad = free[:40], free[40:80]
    for x, y in zip(good, bad):
        some = rng.sample(pairs, 10)
        rows.append((x, " ".join(f"{a} {b} and" for a, b in some)))
        rows.append((y, " ".join(f"{a} {b} and" for (a, _), (_, b) in zip(some, some[1:] + some[:1]))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    score = {r.doc_id: r.score for r in lm_scores(docs, frequent=0.01, block_bytes=20_000).collect()}
    assert all(score[x] > score[y] + 5 for x, y in zip(good, bad))


def test_lm_mixture_is_a_distribution():
    from folio.llm.lm import fit_mixture, mixture, pack, unpack
    rng = np.random.default_rng(1)
    bucket = rng.integers(0, 128, 500)
    w = fit_mixture(bucket, rng.random((500, 3)) + .01, np.ones(500))
    assert np.allclose(w.sum(1), 1) and not w[64:, 0].any() and w[64, 2] == 1
    assert np.allclose(fit_mixture(np.zeros(0, int), np.zeros((0, 3)), np.zeros(0)).sum(1), 1)
    bucket, p3, p2 = mixture(*(np.array(x, float) for x in ([2, 0, 0], [4, 0, 0], [3, 1, 0], [6, 2, 0])))
    assert bucket.tolist() == [5, 67, 64] and p3.tolist() == [.5, 0, 0] and p2.tolist() == [.5, .5, 0]
    for top in (1, 255, 256, 1 << 40, (1 << 64) - 1):
        x = rng.integers(0, top, 50, dtype=np.uint64, endpoint=True)
        assert (unpack(pack(x)) == x).all()
