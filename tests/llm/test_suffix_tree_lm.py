import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from namestrata.llm import suffix_tree_lm
from namestrata.llm.suffix_tree_lm import DEPTH, END, RUN, Scorer, SuffixTree, dealt_out, merged, padded, runs, score, sequence, tree_rows

SCHEMA = "doc_id long, text string, train string, n int"


def some_texts(n=200, seed=1):
    rng = random.Random(seed)
    parts = ["an", "tion", "the", "é", "of", "B", "x1"]
    vocab = ["".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(150)]
    return [" ".join(rng.choices(vocab, k=rng.randint(0, 80))) for _ in range(n)]


def counts_of(sequences):
    out = Counter()
    for s in sequences:
        s = END * DEPTH + s
        for i in range(DEPTH, len(s)):
            for d in range(DEPTH + 1):
                out[d, s[i - d : i + 1]] += 1
    return out


def number(data):
    return int.from_bytes(data, "big")


def test_runs_stay_inside_texts():
    sequences = [sequence(t.encode().split()) for t in some_texts(30)]
    keys, n = merged([np.unique(runs(*padded(sequences)), return_counts=True)])
    want = {number(s): c for (d, s), c in counts_of(sequences).items() if d == DEPTH}
    assert dict(zip(keys.tolist(), n.tolist())) == want


def followers_of(counts):
    by = {}
    for (d, s), n in counts.items():
        by.setdefault((d, s[:-1]), {})[s[-1]] = n
    return by


def kept_of(by):
    """Contexts that pass the test, by the formula."""
    out = set()
    for (d, c), own in by.items():
        total = sum(own.values())
        if d and total >= suffix_tree_lm.LEAST_COUNT:
            short = by[d - 1, c[1:]]
            gain = sum(n * math.log(n / total * sum(short.values()) / short[b]) for b, n in own.items())
            if gain >= suffix_tree_lm.LEAST_GAIN * len(own) * math.log(total):
                out.add((d, c))
    return out


def chance(by, kept, context, byte):
    """The model by recursion over suffixes."""
    own = by.get((len(context), context), {})
    if not context:
        return (own.get(byte, 0) + 0.5) / (sum(own.values()) + 128)
    shorter = chance(by, kept, context[1:], byte)
    if (len(context), context) not in kept:
        return shorter
    back = max(suffix_tree_lm.BACK * len(own), 1)
    return (own.get(byte, 0) + back * shorter) / (sum(own.values()) + back)


def naive(by, kept, sequences):
    out = []
    for s in sequences:
        text = END * DEPTH + s
        out.append(sum(math.log10(chance(by, kept, text[i - DEPTH : i], text[i])) for i in range(DEPTH, len(text))))
    return out


def low_of(by):
    low = np.zeros((256, 256), dtype=np.int64)
    for (d, c), own in by.items():
        if d == 1:
            for b, n in own.items():
                low[c[0], b] = n
    return low


def test_kept_contexts(spark):
    sequences = [sequence(t.lower().encode().split()) for t in some_texts()]
    counts = counts_of(sequences)
    by = followers_of(counts)
    rows = [(RUN, number(s), n) for (d, s), n in counts.items() if d == DEPTH] + [(1, 5, 7), (2, 0, 1)]
    table = spark.createDataFrame(rows, "kind int, key long, n long").repartition(3)
    got = {}
    for r in tree_rows(table, low_of(by)).collect():
        assert r.ending == r.context & 65535
        got[r.depth, r.context] = (r.total, dict(zip(r.next, r.n)))
    kept = kept_of(by)
    assert got == {(d, number(c)): (sum(by[d, c].values()), by[d, c]) for d, c in kept if d > 1} and len(got) > 50
    single = SuffixTree(low_of(by), {}, {}, np.ones(65536, dtype=bool)).single()[0]
    assert {bytes([b]) for b in np.flatnonzero(single)} == {c for d, c in kept if d == 1}


def test_probabilities_sum_to_one(spark):
    sequences = [sequence(t.lower().encode().split()) for t in some_texts(60)]
    counts = counts_of(sequences)
    by = followers_of(counts)
    rows = [(RUN, number(s), n) for (d, s), n in counts.items() if d == DEPTH]
    table = tree_rows(spark.createDataFrame(rows, "kind int, key long, n long"), low_of(by)).toArrow()
    tree = SuffixTree.of(low_of(by), table, np.ones(65536, dtype=bool))
    for context in [b"the tio", b"\n" * 6, b"\xff\x00zzzz", *[s[-7:-1] for s in sequences if len(s) > 8][:20]]:
        run = np.array([number(context[-6:] + bytes([b])) for b in range(256)], dtype=np.uint64)
        assert (10.0 ** tree.log10(run)).sum() == pytest.approx(1)


def test_remembered_runs_give_the_same():
    tree = SuffixTree(np.ones((256, 256), dtype=np.int64), {}, {}, np.ones(65536, dtype=bool))
    tree.log10 = lambda run: -(run % np.uint64(1009)).astype(np.float64)
    scorer = Scorer(tree)
    rng = np.random.default_rng(5)
    for most in (1 << 55, 1 << 40, 50, 1):
        for _ in range(4):
            run = rng.integers(0, most, 300_000, dtype=np.uint64)
            assert (scorer.log10(run) == tree.log10(run)).all()


def test_shards_of_endings():
    of, shards = dealt_out({5: 10, 6: 70, 9: 30, 11: 30}, 100)
    load = Counter()
    for e, n in {5: 10, 6: 70, 9: 30, 11: 30}.items():
        load[of[e]] += n
    assert shards == 2 and max(load.values()) == 70
    assert dealt_out({}, 10)[1] == 1 and dealt_out({3: 5}, 10)[1] == 1


def brute_base(rows):
    words = lambda t: (t or "").encode().lower().split()
    train = [zlib.crc32(str(d).encode()) % 5 != 1 if d is not None else False for d, *_ in rows]
    c = Counter()
    for ok, (_, text, *_) in zip(train, rows):
        if ok:
            c.update([*words(text), None])
    n, v = sum(c.values()), len(c)
    out = []
    for doc, text, *_ in rows:
        tokens = [*words(text), None]
        held = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1
        base = sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        out.append((str(doc), held, len(tokens), sum(c[t] > 0 for t in tokens), n, pytest.approx(base)))
    return out


@pytest.mark.parametrize("words", [40, 4_000_000])
def test_base_matches_brute_force(spark, monkeypatch, words):
    monkeypatch.setattr(suffix_tree_lm, "HELD_WORDS", words)
    rows = [(i, t, "clash", 1) for i, t in enumerate(some_texts(120, 4))]
    rows += [rows[3], rows[3], (None, "the an", None, None), (500, None, "x", 1), (501, "", "x", 1), (502, "w " * 20000, "x", 1)]
    got = score(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got]
    assert sorted(got, key=lambda r: r[:5]) == sorted(brute_base(rows), key=lambda r: r[:5])


def test_nothing_to_learn_from(spark):
    assert score(spark.createDataFrame([], SCHEMA)).count() == 0
    (row,) = score(spark.createDataFrame([(None, "a b", None, 1)], SCHEMA)).collect()
    assert row.train_tokens == 0 and row.n_known == 0 and row.score == pytest.approx(-4 * math.log10(256), rel=1e-5)


def test_tree_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = [r for r in score(docs).collect() if r.held_out]
    assert len(held) > 1000
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert sum(r.score > r.base_score for r in held) > 0.8 * len(held)


@pytest.mark.parametrize("held", [500, 4_000_000])
def test_scores_match_the_recursion(spark, monkeypatch, held):
    """Scores equal those of the tree of all contexts, however few of them a task holds."""
    monkeypatch.setattr(suffix_tree_lm, "HELD_RUNS", held)
    rows = [(i, t, "x", 1) for i, t in enumerate(some_texts(120, 7))] + [(None, "zq \xff the", "x", 1), (500, None, "x", 1)]
    rows += [(501, "the the", "x", 1), (501, "the the", "x", 2), (501, "an", "x", 2)]
    train = [sequence((t or "").lower().encode().split()) for d, t, *_ in rows if d is not None and zlib.crc32(str(d).encode()) % 5 != 1]
    by = followers_of(counts_of(train))
    want = naive(by, kept_of(by), [sequence((t or "").lower().encode().split()) for _, t, *_ in rows])
    got = score(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    bag = lambda x: sorted((str(d), round(s, 5)) for d, s in x)
    assert bag((r.doc_id, r.score) for r in got) == bag((r[0], w) for r, w in zip(rows, want))


def test_the_driver_reads_a_depth_at_a_time(spark, monkeypatch):
    """No table that comes to the driver holds contexts of two depths, and what is built is the same."""
    texts = some_texts(120)
    seen, whole = [], []
    real = SuffixTree.of_depths.__func__

    def watched(cls, low, parts, mine):
        parts = list(parts)
        seen.extend((depth, part.column_names) for depth, part in parts)
        whole.append((real(cls, low, iter(parts), mine), mine.all()))
        return whole[-1][0]

    monkeypatch.setattr(SuffixTree, "of_depths", classmethod(watched))
    rows = score(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert [depth for depth, _ in seen] == list(range(2, DEPTH + 1))
    assert len(rows) == len(texts) and all(r.score < 0 for r in rows)
    (tree, all_mine), = whole
    assert all_mine
    for depth, (run, n) in tree.followers.items():
        context = tree.contexts[depth][0]
        assert (np.diff(run.astype(np.int64)) > 0).all() and (np.diff(context.astype(np.int64)) > 0).all()
        assert set((run >> np.uint64(8)).tolist()) == set(context.tolist())
        # The counts of a context's next bytes add up to its total.
        sums = np.zeros(len(context))
        np.add.at(sums, np.searchsorted(context, run >> np.uint64(8)), n)
        assert (sums == tree.contexts[depth][1]).all()
