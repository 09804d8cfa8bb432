import random

import numpy as np
import pytest
import xxhash

from namestrata.llm import golay
from namestrata.llm.components import connected_components, spanning_stars
from namestrata.llm.fuzzy_simhash import drop_near_duplicates, fingerprint, links, links_of_groups, near_duplicates

SCHEMA = "doc_id long, text string, fp string, key int"


def brute_components(fps, most=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_code_is_perfect():
    table = golay.decoder()
    assert (table >= 0).all()
    words = golay.codewords()
    assert min(bin(int(w)).count("1") for w in words[1:]) == 7


def test_keys_meet_within_four_bits():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    other = base.copy()
    for row in range(len(other)):
        for bit in rng.choice(64, row % 5, replace=False):
            other[row] ^= np.uint64(1 << int(bit))
    found = [set() for _ in base], [set() for _ in base]
    for sets, fps in zip(found, (base, other)):
        rows, keys = golay.fuzzy_keys(fps)
        for r, k in zip(rows.tolist(), keys.tolist()):
            sets[r].add(k)
    assert all(a & b for a, b in zip(*found))


@pytest.mark.parametrize("seed", range(6))
def test_links_span_groups(seed):
    rng = np.random.default_rng(seed)
    n = [5, 60, 300, 900, 40, 200][seed]
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = base[rng.integers(0, 4, n)]
    for _ in range(int(rng.integers(2, 7))):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    fps = np.unique(fps)
    u, v = links_of_groups(np.zeros(len(fps), dtype=np.int64), fps, 4)
    a, b = spanning_stars(u, v)
    assert len(a) < len(fps)
    want = brute_components([int(x) for x in fps])
    place = {int(x): i for i, x in enumerate(fps)}
    got = list(range(len(fps)))
    for x, y in zip(a, b):
        x, y = place[int(x)], place[int(y)]
        assert want[x] == want[y]
        got[y] = x
    assert len({got[got[i]] for i in range(len(fps))}) == len(set(want))


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1200)] + [(3, 3), (50, 40), (40, 50)]
    rows = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r.node: r.root for r in rows}
    assert len(rows) == len(got)
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 7 for i in range(1000, 1200))
    assert got[50] == got[40] == 40 and 3 not in got


def texts():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(30, 200))) for _ in range(40)]
    rows = list(base)
    for t in base[:20]:
        for _ in range(6):
            words = t.split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append(" ".join(words))
    return rows + [None, "", "  \n", "one", "ONE", "two words", "É é", base[0].upper(), "x " * 30000]


def test_components_match_brute_force(spark):
    rows = [(i * 3 % 1009, t, "clash", i) for i, t in enumerate(texts())]
    rows += [rows[5], rows[5], (None, rows[7][1], None, None)]
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(out) == len(rows)
    fps = [plain_fingerprint(r[1]) for r in rows]
    assert all(fingerprint(r[1].encode() if r[1] else None) == f for r, f in zip(rows, fps))
    classes = brute_components(fps)
    least = {}
    for r, c in zip(rows, classes):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = sorted((str(r[0]), f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, classes))
    assert sorted((str(o.doc_id), o.fingerprint, o.component_id) for o in out) == want


def test_one_document_stays(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(texts())]
    rows += [(2, rows[2][1], "x", 2), (None, "null id", "x", 0), (None, "null id", "x", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    named = [r for r in rows if r[0] is not None]
    classes = brute_components([plain_fingerprint(r[1]) for r in named])
    want = sorted({min(named[i][0] for i in range(len(named)) if classes[i] == c) for c in classes})
    got = [r.doc_id for r in kept.collect()]
    assert sorted(g for g in got if g is not None) == want and got.count(None) == 2


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).count() == 0 and drop_near_duplicates(empty).count() == 0


def test_a_dense_group_gives_few_rows(spark):
    """Ten for each fingerprint at most, however many tasks its keys are dealt out to."""
    rng = random.Random(5)
    base = rng.getrandbits(63)
    group = sorted({base ^ 1 << rng.randrange(63) ^ 1 << rng.randrange(63) for _ in range(500)} | {base})
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(held, ("200", "false")):
            spark.conf.set(k, v)
        found = links(spark.createDataFrame([(x,) for x in group], "fp long")).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(found) <= 10 * len(group)
    reached = {base}
    while more := {x for r in found for x in (r.a, r.b) if (r.a in reached) != (r.b in reached)} - reached:
        reached |= more
    assert reached == set(group)
