import math

import numpy as np
import pytest

from namestrata.llm import graph_search
from namestrata.llm.graph_search import nearest
from namestrata.llm.pruned_graph import beam_search, build, lifted, robust_prune

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, every=20, k=20):
    valid = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            v = [float(np.float32(x)) for x in v]
            valid[i] = min(valid.get(i, v), v)
    out = {}
    for q, v in valid.items():
        if q % every == 0:
            scores = [(-float(np.dot(np.array(v), np.array(w))), i) for i, w in valid.items() if i != q and len(w) == len(v)]
            out[q] = sorted(scores)[:k]
    return out


def recall(got, want):
    right = total = 0
    for q, best in want.items():
        worst = best[-1][0] if best else 0
        own = got.get(q, [])
        assert [r.rank for r in own] == list(range(1, len(own) + 1)) and len(own) == len(best)
        assert own == sorted(own, key=lambda r: (-r.score, r.vec_id)) and len({r.vec_id for r in own}) == len(own)
        right += sum(-r.score <= worst + 1e-9 for r in own)
        total += len(best)
    return right / max(1, total)


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r)
    return out


def test_pruning_keeps_diverse_edges():
    points = np.array([[0, 0], [1, 0], [1.1, 0], [0, 1.5], [-3, 0]], dtype=np.float32)
    edges = robust_prune(points, np.array([0]), np.array([[1, 2, 3, 4, 1, -1]]), 4, 1.2)
    assert edges.tolist() == [[1, 3, 4, -1]]


def test_graph_finds_near_points():
    rng = np.random.default_rng(1)
    points = lifted(rng.normal(size=(1500, 12)).astype(np.float32))
    graph, entry = build(points)
    queries = points[::50]
    ids, far, _ = beam_search(points, graph, entry, queries, 60)
    exact = ((queries[:, None] - points[None]) ** 2).sum(axis=2)
    want = np.argsort(exact, axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, want)]) > 0.97
    assert np.allclose(np.take_along_axis(exact, ids[:, :10], 1), far[:, :10], atol=1e-3)


@pytest.mark.parametrize("shard", [16_384, 150])
def test_recall_on_the_table(spark, monkeypatch, shard):
    monkeypatch.setattr(graph_search, "SHARD", shard)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in table.collect()])
    assert recall(grouped(nearest(table).collect()), want) >= 0.95


def test_odd_rows_and_copies(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist(), 1, "x") for i in range(300)]
    same = (10 * rng.normal(size=6)).tolist()
    rows += [(1000 + i, same, 1, "x") for i in range(400)]
    rows += [(2000, None, 1, "x"), (2020, [0.0] * 6, 1, "x"), (2040, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, "x"), (2060, [float("nan")] * 6, 1, "x")]
    rows += [(2080, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0], 1, "x"), (None, same, None, None), (2100, [1.0, 2.0], 1, "x"), (2101, [3.0, 1.0], 1, "x")]
    rows += [(2120, [], 1, "x"), (2140, [5.0], 1, "x"), rows[3], rows[3], (40, same, 1, "x")]
    got = grouped(nearest(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect())
    want = {q: best for q, best in brute(rows).items() if best}
    assert set(got) == set(want)
    assert recall(got, want) >= 0.98
    for q in (1000, 1020, 1380):
        assert [r.vec_id for r in got[q]] == [i for i in [40, *range(1000, 1021)] if i != q][:20]


def test_empty_table(spark):
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0
