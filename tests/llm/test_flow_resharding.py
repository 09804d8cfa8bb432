import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest

from namestrata.llm.flow_resharding import Block, assign, min_cost_flow, reshard, rewrite
from tests.conftest import SF

SCHEMA = "doc_id long, text string, shard string, size int"


def cheapest(supply, demand, cost):
    """Least cost by trying every way to hand out each unit in order."""
    units = [i for i, n in enumerate(supply) for _ in range(n)]
    best = None
    for sinks in itertools.product(range(len(demand)), repeat=len(units)):
        if Counter(sinks) == Counter({j: n for j, n in enumerate(demand) if n}):
            price = sum(cost[i][j] for i, j in zip(units, sinks))
            best = price if best is None else min(best, price)
    return best


@pytest.mark.parametrize("seed", range(8))
def test_flow_is_cheapest(seed):
    rng = random.Random(seed)
    supply = [rng.randint(0, 3) for _ in range(3)]
    demand = [0] * 3
    for _ in range(sum(supply)):
        demand[rng.randrange(3)] += 1
    cost = [[rng.randint(0, 5) for _ in range(3)] for _ in range(3)]
    flow = min_cost_flow(supply, demand, cost)
    assert [sum(r) for r in flow] == supply and [sum(c) for c in zip(*flow)] == demand
    assert sum(f * c for fr, cr in zip(flow, cost) for f, c in zip(fr, cr)) == cheapest(supply, demand, cost)


def test_assignment_is_even_and_moves_little():
    rng = random.Random(2)
    blocks = [Block(i, {-1: 1}, rng.randint(100, 3000), i % 16) for i in range(4000)]
    assign(blocks, 16, 24)
    total = sum(b.size for b in blocks)
    load = Counter()
    for b in blocks:
        load[b.new] += b.size
    assert max(load.values()) - min(load.values()) <= 0.002 * total / 24
    assert sum(b.size for b in blocks if b.new != b.old) <= 1.02 * total / 3


def verify(rows, docs, even):
    assert len(rows) == len(docs)
    want = Counter((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in docs)
    assert Counter((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    slots, load, texts = defaultdict(list), Counter(), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        texts[r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and r.moved == (r.shard != r.old_shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    sizes = [load[k] for k in range(24)]
    assert max(sizes) - min(sizes) <= even
    return texts


def test_places_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    texts = verify(reshard(docs).collect(), rows, 2000)
    assert sum(len(s) > 1 for s in texts.values()) <= 3


def test_hot_text_and_odd_rows(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 60))), "x", 1) for i in range(900)]
    docs += [(1000 + i, "hot " * 20, "x", 1) for i in range(500)] + [(2000 + i, "", "x", 1) for i in range(500)]
    docs += [(3000, None, "x", 1), (None, "no id", None, None), docs[5], docs[5], (5, "other", "x", 1)]
    verify(reshard(spark.createDataFrame(docs, SCHEMA).repartition(4)).collect(), docs, 400)


def test_empty_table(spark):
    assert reshard(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rewrites_changed_shards_only(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    placed = reshard(docs, new_shards=17, old_shards=16).cache()
    changed = rewrite(docs, placed, f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    want = {r.doc_id: (r.shard, r.slot) for r in placed.collect() if r.shard in set(changed)}
    assert {r.doc_id: (r.shard, r.slot) for r in out.collect()} == want
    assert 16 in changed and set(docs.columns) < set(out.columns)
