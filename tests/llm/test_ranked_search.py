import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from namestrata.llm import ranked_search
from namestrata.llm.ranked_search import Shard, search, smallest
from tests.conftest import SF

DOCS = "doc_id long, text string, rank int, item long, terms string"
ITEMS = "item_id long, text string, score int"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, k=10):
    held = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for d, c in held:
            m = 25 + (75 * sum(c.values()) * n) // length
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(str(item), i + 1, str(d), -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def odd_rows():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["Été", "中文", "Mixed", "mixed"]
    text = lambda n: " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=n))
    docs = [(i, text(rng.choice([1, 3, 10, 80])), i, i, "clash") for i in range(400)]
    docs += [(5000 - i, docs[7][1], 0, 0, "copy") for i in range(40)]
    docs += [(900, None, 0, 0, ""), (901, "", 0, 0, ""), (902, "-- ;", 0, 0, ""), (None, docs[7][1], 0, 0, ""), (7, docs[7][1], 1, 1, ""), (7, docs[7][1], 1, 1, "")]
    docs.append((903, "w1 w2 " * 60_000, 0, 0, ""))
    items = [(i, text(rng.choice([1, 2, 5, 30])), 0) for i in range(30)]
    items += [(50, docs[7][1], 0), (50, docs[7][1], 0), (51, None, 0), (52, "", 0), (None, "w3 w3 w3 w9", 0), (53, "nowhere", 0), (54, "MIXED été ÉTÉ", 0)]
    return docs, items


@pytest.mark.parametrize("shard, block", [(2_000_000, 16 << 20), (300, 200)])
def test_odd_rows_match_brute_force(spark, monkeypatch, shard, block):
    docs, items = odd_rows()
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", block)
    tables = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    got = search(*tables, shard=shard).collect()
    assert sorted((str(r.item_id), r.rank, str(r.doc_id), r.score) for r in got) == plain_search([d[:2] for d in docs], [i[:2] for i in items])


def test_tables_match_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted((str(r.item_id), r.rank, str(r.doc_id), r.score) for r in search(docs, items).collect()) == want


@pytest.mark.parametrize("seed", range(8))
def test_best_positions_against_all_scores(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(ranked_search, "FIRST_DEPTH", int(rng.integers(1, 20)))
    docs, size = int(rng.integers(1, 400)), int(rng.integers(1, 30))
    held = rng.random((docs, size)) < rng.choice([0.1, 0.5, 1.0])
    held[:, 0] |= ~held.any(axis=1)
    impact = np.where(held, rng.integers(1, rng.choice([3, 1000]), (docs, size)), 0)
    begin = np.concatenate([[0], np.cumsum(held.sum(axis=1))])
    ids = rng.permutation(docs) * 3
    shard = Shard(size, ids, begin, np.nonzero(held)[1], impact[held])
    numbers = rng.permutation(size)[: int(rng.integers(1, size + 1))]
    repeats = rng.integers(1, 4, len(numbers))
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    scores, found = shard.search(numbers, repeats, 10, none, size)
    want = smallest(impact[:, numbers] @ repeats, ids, 10)
    assert scores.tolist() == want[0].tolist() and found.tolist() == want[1].tolist()


def test_lists_are_not_read_to_the_end(monkeypatch):
    rng = np.random.default_rng(1)
    impact = np.sort(rng.integers(1, 50, (20_000, 3)), axis=0)
    impact[-30:] += 1000
    shard = Shard(3, np.arange(20_000), np.arange(20_001) * 3, np.tile(np.arange(3), 20_000), impact.reshape(-1))
    met = []
    monkeypatch.setattr(ranked_search, "smallest", lambda s, i, k: met.append(len(s)) or smallest(s, i, k))
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    scores, _ = shard.search(np.arange(3), np.ones(3, dtype=np.int64), 10, none, 3)
    assert len(scores) == 10 and sum(met) < 200


def test_empty_tables(spark):
    docs, items = odd_rows()
    docs, items = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert search(docs.limit(0), items).count() == 0
    assert search(docs, items.limit(0)).collect() == []
    assert search(docs.where("text = ''"), items).count() == 0
