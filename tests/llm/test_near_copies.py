import random

import numpy as np
import pytest

from namestrata.llm import near_copies
from namestrata.llm.near_copies import candidates, copies, drop_near_copies, shingles, verified, words_of

SCHEMA = "doc_id long, text string, body string, root int, own_id int"


def jaccard(a, b, width=5):
    a, b = (set(shingles(words_of(t.encode()), width).tolist()) for t in (a or "", b or ""))
    return len(a & b) / len(a | b)


def planted(seed=3):
    """(rows, copies of known similarity): texts, and copies with some words changed."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    rows, pairs = [], []
    for i in range(60):
        base = rng.choices(vocab, k=rng.randint(60, 400))
        rows.append((10 * i, " ".join(base)))
        for k in range(3):
            words = list(base)
            for _ in range(max(1, int(len(words) * rng.choice([0.005, 0.01, 0.015, 0.02])))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((10 * i + 1 + k, " ".join(words)))
            pairs.append((rows[-1][0], 10 * i, jaccard(rows[-1][1], " ".join(base))))
    return rows, pairs


@pytest.mark.parametrize("tile", [4096, 3])
def test_planted_copies_are_found_and_none_else(spark, tile):
    rows, pairs = planted()
    out = copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), tile=tile).collect()
    root = {r.doc_id: r.least_id for r in out}
    assert len(out) == len(rows)
    good = [(a, b) for a, b, j in pairs if j >= 0.8]
    assert len(good) > 100 and sum(root[a] == root[b] for a, b in good) >= 0.95 * len(good)
    # What is connected is connected by true copies.
    text = dict(rows)
    for doc, least in root.items():
        assert doc // 10 == least // 10
        group = [d for d in root if root[d] == least]
        assert len(group) == 1 or any(d != doc and jaccard(text[d], text[doc]) >= 0.8 for d in group)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(40_000))
    rows = [(1, "a b c d e f g", "x", 1, 1), (1, "unlike text of its own here", "x", 1, 1), (2, "a  b\nC d e f G", "x", 2, 2)]
    rows += [(None, "a b c d e f g", "x", 1, 1)] * 2 + [(3, None, "x", 1, 1), (4, "", "x", 1, 1), (5, "one", "x", 1, 1), (6, "ONE", "x", 1, 1), (7, "two", "x", 1, 1)]
    rows += [(8, long, "x", 1, 1), (9, long + " tail", "x", 1, 1), (1, "a b c d e f g", "x", 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"root": "a`b.c"})
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    want = [rows[0], rows[1], rows[3], rows[4], rows[5], rows[7], rows[9], rows[10]]
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, want))
    assert drop_near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_verified_links_connect_as_brute_force(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 500, int(rng.integers(5, 40)))
        for _ in range(int(rng.integers(1, 9))):
            other = base.copy()
            other[rng.integers(0, len(base), int(rng.integers(0, 4)))] = rng.integers(0, 500)
            sets.append(np.unique(other).astype(np.uint64))
    n = len(sets)
    side = np.full(n, -1) if seed % 2 else rng.integers(0, 2, n)
    root = list(range(n))

    def find(r, i):
        while r[i] != i:
            i = r[i]
        return i

    for i in range(n):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common) and (side[i] < 0 or side[i] != side[j]):
                root[find(root, i)] = find(root, j)
    mine = list(range(n))
    for a, b in zip(*verified(sets, side, 0.8)):
        common = len(np.intersect1d(sets[a], sets[b]))
        assert common >= 0.8 * (len(sets[a]) + len(sets[b]) - common)
        mine[find(mine, a)] = find(mine, b)
    groups = lambda r: {frozenset(i for i in range(n) if find(r, i) == k) for k in range(n)}
    assert groups(mine) == groups(root)


def test_one_large_cluster_of_copies(spark):
    """Copies of one text that are like it, and mostly not like each other."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        words = list(base)
        for _ in range(4):
            words[rng.randrange(300)] = f"n{i}"
        rows.append((i, " ".join(words)))
    out = copies(spark.createDataFrame(rows, "doc_id long, text string"), tile=100).collect()
    assert sum(r.least_id == 0 for r in out) >= 0.97 * len(rows)


def test_candidates_are_no_more_than_fingerprints(spark):
    """A dense group links its members many times over; contents are joined once per fingerprint."""
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    prints = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (800, 2))}
    rows = [(i, [fp, fp ^ 5]) for i, fp in enumerate(sorted(prints))]
    nodes = spark.createDataFrame(rows, "content long, fps array<long>").repartition(4)
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = candidates(nodes, 2).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(found) <= 2 * len(rows)
    assert {x for r in found for x in r} == set(range(len(rows)))


def test_no_task_has_two_steps_of_python(spark, monkeypatch):
    """Each would be a worker of its own, which an executor keeps."""
    plans, thin = [], near_copies.thinned

    def thinned(edges):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return thin(edges)

    monkeypatch.setattr(near_copies, "thinned", thinned)
    rows, _ = planted()
    copies(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert len(plans) == 2 and not any("InArrow" in p for p in plans)
