"""A directed graph of near neighbours with robust pruning, and beam search over it."""

from __future__ import annotations

import numpy as np

#: Edges of a node, beam while building, relaxation of the pruning rule, points added at once.
DEGREE, BUILD_BEAM, ALPHA, BATCH = 32, 56, 1.2, 256
#: Beam entries expanded in one step.
WIDTH = 4
NONE = -1


def lifted(vectors: np.ndarray) -> np.ndarray:
    """One more coordinate that gives all vectors one length, so that the nearest by distance to
    a query (with zero there) are those of the largest inner product."""
    norms = np.einsum("ij,ij->i", vectors, vectors)
    extra = np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0.0))
    return np.concatenate([vectors, extra[:, None]], axis=1).astype(np.float32)


def beam_search(
    points: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(beam ids, squared distances, expanded ids) of every query, nearest first, NONE for no point.

    Greedy: the nearest points of the beam that were not expanded yet are, until all were.
    All queries of the call advance together.
    """
    n = len(queries)
    square = np.einsum("ij,ij->i", points, points)
    ids = np.full((n, beam), NONE, dtype=np.int64)
    far = np.full((n, beam), np.inf, dtype=np.float32)
    done = np.ones((n, beam), dtype=bool)
    ids[:, 0] = entry
    far[:, 0] = square[entry] - 2 * queries @ points[entry]
    done[:, 0] = False
    expanded = []
    live = np.arange(n)
    while len(live):
        own, now = done[live], ids[live]
        # The first open places of each beam, which is sorted by distance.
        order = np.argsort(own, axis=1, kind="stable")[:, :WIDTH]
        open_ = ~np.take_along_axis(own, order, 1)
        chosen = np.where(open_, np.take_along_axis(now, order, 1), NONE)
        np.put_along_axis(own, order, True, 1)
        step = np.full((n, chosen.shape[1]), NONE, dtype=np.int64)
        step[live] = chosen
        expanded.append(step)
        next_ = graph[chosen].reshape(len(live), -1)
        next_[np.repeat(chosen == NONE, graph.shape[1], axis=1)] = NONE
        # A point may follow several of the expanded ones, or be in the beam already.
        next_.sort(axis=1)
        next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = NONE
        spot = np.sort(now, axis=1)
        base = np.arange(len(live), dtype=np.int64)[:, None] * (len(points) + 1) + 1
        flat = (spot + base).reshape(-1)
        at = np.searchsorted(flat, (next_ + base).reshape(-1)).reshape(next_.shape)
        known = flat[np.minimum(at, len(flat) - 1)] == next_ + base
        bad = known | (next_ == NONE)
        gone = np.einsum("bd,brd->br", queries[live], points[next_], optimize=False)
        distance = np.where(bad, np.inf, square[next_] - 2 * gone).astype(np.float32)
        all_far = np.concatenate([far[live], distance], axis=1)
        all_ids = np.concatenate([now, next_], axis=1)
        all_done = np.concatenate([own, bad], axis=1)
        keep = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        far[live] = np.take_along_axis(all_far, keep, 1)
        ids[live] = np.where(np.isinf(far[live]), NONE, np.take_along_axis(all_ids, keep, 1))
        done[live] = np.take_along_axis(all_done, keep, 1) | np.isinf(far[live])
        live = live[~done[live].all(axis=1)]
    return ids, far + np.einsum("ij,ij->i", queries, queries)[:, None], np.concatenate(expanded, axis=1)


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Edges of the points ``own`` from their candidates (rows, NONE for none).

    The nearest candidate is kept; it covers all that are ``alpha`` times nearer to it than to the
    point; and so on with the nearest that is left.
    """
    bad = (candidates == NONE) | (candidates == own[:, None])
    there = points[candidates]
    mine = points[own]
    to = np.einsum("bcd,bcd->bc", there - mine[:, None], there - mine[:, None])
    to = np.where(bad, np.inf, to)
    order = np.argsort(to, axis=1, kind="stable")
    candidates = np.take_along_axis(candidates, order, 1)
    to = np.take_along_axis(to, order, 1)
    there = points[candidates]
    square = np.einsum("bcd,bcd->bc", there, there)
    between = square[:, :, None] + square[:, None, :] - 2 * there @ there.transpose(0, 2, 1)
    left = np.isfinite(to)
    rows = np.arange(len(own))
    out = np.full((len(own), degree), NONE, dtype=np.int64)
    for k in range(degree):
        some = left.any(axis=1)
        if not some.any():
            break
        first = left.argmax(axis=1)
        out[some, k] = candidates[rows[some], first[some]]
        left &= alpha * alpha * between[rows, first] > to
        left[rows, first] = False
        # The same point twice among the candidates.
        left &= candidates != candidates[rows, first][:, None]
    return out


def build(points: np.ndarray, seed: int = 0) -> tuple[np.ndarray, int]:
    """(graph, entry) of the points: rows of at most DEGREE neighbours, NONE where there are fewer.

    Points join in random order, in batches that double up to BATCH; a batch is searched in the
    graph so far, pruned, and linked back.
    """
    n = len(points)
    graph = np.full((n, DEGREE), NONE, dtype=np.int64)
    middle = points.mean(axis=0, dtype=np.float64).astype(np.float32)
    entry = int(np.argmin(((points - middle) ** 2).sum(axis=1)))
    order = np.random.default_rng(seed).permutation(n)
    order = order[order != entry]
    at = 0
    while at < len(order):
        batch = order[at : at + min(BATCH, at + 1)]
        _, _, seen = beam_search(points, graph, entry, points[batch], BUILD_BEAM)
        # Points of one batch do not see each other in the graph; while it is small they may be
        # near neighbours all the same.
        if at < 4 * BATCH:
            seen = np.concatenate([seen, np.broadcast_to(batch, (len(batch), len(batch)))], axis=1)
        for i in range(0, len(batch), 128):
            part = slice(i, i + 128)
            graph[batch[part]] = robust_prune(points, batch[part], seen[part], DEGREE, ALPHA)
        link_back(points, graph, batch)
        at += len(batch)
    return graph, entry


def link_back(points: np.ndarray, graph: np.ndarray, batch: np.ndarray) -> None:
    """Edges against those of the batch; a node that gets too many is pruned again."""
    edges = graph[batch]
    source = np.repeat(batch, graph.shape[1])[edges.reshape(-1) != NONE]
    target = edges[edges != NONE]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
    for size in (8, 64, len(source)):
        some = counts <= size
        if some.any():
            wide = int(counts[some].max())
            for i in range(0, int(some.sum()), 128):
                own, begin, n = nodes[some][i : i + 128], first[some][i : i + 128], counts[some][i : i + 128]
                columns = np.arange(wide)[None, :]
                new = np.where(columns < n[:, None], source[np.minimum(begin[:, None] + columns, len(source) - 1)], NONE)
                new[(new[:, :, None] == graph[own][:, None, :]).any(axis=2)] = NONE
                joined = np.concatenate([graph[own], new], axis=1)
                room = (joined != NONE).sum(axis=1) <= graph.shape[1]
                packed = np.take_along_axis(joined, np.argsort(joined == NONE, axis=1, kind="stable"), 1)
                graph[own[room]] = packed[room][:, : graph.shape[1]]
                if not room.all():
                    graph[own[~room]] = robust_prune(points, own[~room], joined[~room], graph.shape[1], ALPHA)
            nodes, first, counts = nodes[~some], first[~some], counts[~some]
