"""A graph over vectors for nearest-neighbour search, built in numpy: greedy search, robust pruning, beam search.

All work goes in batches of points, so that a step of many searches is one array operation. Nearness is
Euclidean; largest inner products come from it by one more coordinate (see ``lifted``).
"""

from __future__ import annotations

import numpy as np

DEGREE, BUILD_BEAM, SEARCH_BEAM = 32, 64, 96
RELAXED = 1.2  # a neighbour is dropped when another one is this much nearer to it than the point is
ENTRIES = 16
BATCH = 512


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled to at most length 1, with a coordinate that brings all to length 1.

    To a query with 0 there, the nearest by distance is then that with the largest inner product.
    """
    scaled = vectors.astype(np.float64)
    scaled = scaled / max(np.abs(scaled).max(initial=0.0), np.finfo(np.float64).tiny)
    squares = np.einsum("ij,ij->i", scaled, scaled)
    most = squares.max(initial=0.0) or 1.0
    last = np.sqrt(np.maximum(most - squares, 0.0))
    return (np.column_stack([scaled, last]) / np.sqrt(most)).astype(np.float32)


class Graph:
    """Points with at most ``degree`` neighbours each; -1 fills the rows of ``edges``."""

    def __init__(self, points: np.ndarray, edges: np.ndarray) -> None:
        self.points, self.edges = points, edges
        n = len(points)
        middle = int(np.argmax(points @ points.mean(axis=0))) if n else 0
        spread = np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int64) if n else np.zeros(0, np.int64)
        self.entries = np.unique(np.append(spread, middle))[: n or 0]

    def search(self, queries: np.ndarray, beam: int, within: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query the best ``beam`` points met, nearest first, their nearness, and which were expanded.

        Each step every search that goes on expands its best point not yet expanded. Missing places hold -1.
        ``within``: only the first points are in the graph so far.
        """
        n, entries = within or len(self.points), self.entries[self.entries < (within or len(self.points))]
        entries = entries if len(entries) else np.zeros(1, np.int64)
        rows = len(queries)
        seen = np.zeros((rows, n), bool)
        seen[:, entries] = True
        ids = np.full((rows, beam), -1, np.int64)
        near = np.full((rows, beam), -np.inf, np.float32)
        done = np.zeros((rows, beam), bool)
        k = min(beam, len(entries))
        first = queries @ self.points[entries].T
        order = np.argsort(-first, axis=1, kind="stable")[:, :k]
        ids[:, :k], near[:, :k] = entries[order], np.take_along_axis(first, order, 1)
        going = np.arange(rows)
        while len(going):
            open_ones = (ids[going] >= 0) & ~done[going]
            at = open_ones.argmax(axis=1)
            still = open_ones[np.arange(len(going)), at]
            going, at = going[still], at[still]
            if not len(going):
                break
            done[going, at] = True
            next_ids = self.edges[ids[going, at]].astype(np.int64)
            fresh = (next_ids >= 0) & ~seen[going[:, None], next_ids]
            seen[np.broadcast_to(going[:, None], next_ids.shape)[fresh], next_ids[fresh]] = True
            score = np.einsum("ij,ikj->ik", queries[going], self.points[next_ids])
            score[~fresh] = -np.inf
            both_ids = np.concatenate([ids[going], np.where(fresh, next_ids, -1)], axis=1)
            both = np.concatenate([near[going], score], axis=1)
            both_done = np.concatenate([done[going], np.zeros_like(fresh)], axis=1)
            order = np.argsort(-both, axis=1, kind="stable")[:, :beam]
            ids[going] = np.take_along_axis(both_ids, order, 1)
            near[going] = np.take_along_axis(both, order, 1)
            done[going] = np.take_along_axis(both_done, order, 1)
        return ids, near, done


def _distinct(ids: np.ndarray) -> np.ndarray:
    """The rows sorted, with -1 for what repeats."""
    ids = np.sort(ids, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    return ids


def robust_prune(points: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, relaxed: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each point ``of`` out of its row of candidates (-1: none).

    The nearest candidate is kept, and those that are ``relaxed`` times nearer to it than to the point go; and so on.
    """
    candidates = _distinct(candidates)
    candidates[candidates == of[:, None]] = -1
    vectors = points[candidates]
    far = 2 - 2 * np.einsum("ij,ikj->ik", points[of], vectors)  # squared distances of vectors of length 1
    alive = candidates >= 0
    kept = np.full((len(of), degree), -1, np.int64)
    rows = np.arange(len(of))
    for place in range(degree):
        best = np.where(alive, far, np.inf).argmin(axis=1)
        ok = alive[rows, best]
        if not ok.any():
            break
        kept[:, place] = np.where(ok, candidates[rows, best], -1)
        between = 2 - 2 * np.einsum("ij,ikj->ik", vectors[rows, best], vectors)
        alive &= ~((relaxed * relaxed * between <= far) & ok[:, None])
        alive[rows, best] = False
    return kept


def _linked_back(graph: Graph, new: np.ndarray, kept: np.ndarray, degree: int, relaxed: float) -> None:
    """Edges from the kept neighbours to the new points; where there are too many, they are pruned."""
    ends, starts = kept[kept >= 0], np.repeat(new, (kept >= 0).sum(axis=1))
    order = np.argsort(ends, kind="stable")
    ends, starts = ends[order], starts[order]
    targets, first, counts = np.unique(ends, return_index=True, return_counts=True)
    for at in range(0, len(targets), BATCH):
        some, n = targets[at : at + BATCH], counts[at : at + BATCH]
        wide = np.full((len(some), int(n.max())), -1, np.int64)
        inside = np.arange(wide.shape[1])[None, :] < n[:, None]
        wide[inside] = starts[first[at] : first[at] + int(n.sum())]
        merged = _distinct(np.concatenate([graph.edges[some].astype(np.int64), wide], axis=1))
        size = (merged >= 0).sum(axis=1)
        fits = size <= degree
        if fits.any():
            rows = np.take_along_axis(merged[fits], np.argsort(merged[fits] < 0, axis=1, kind="stable"), 1)[:, :degree]
            graph.edges[some[fits]] = rows
        if not fits.all():
            graph.edges[some[~fits]] = robust_prune(graph.points, some[~fits], merged[~fits], degree, relaxed)


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relaxed: float = RELAXED) -> Graph:
    """A graph over distinct vectors. Points come in batches that double until ``BATCH``; what a search meets are candidates."""
    points = lifted(vectors)
    n = len(points)
    graph = Graph(points, np.full((n, degree), -1, np.int32))
    first = min(n, degree)
    if first > 1:  # all of the first ones see each other
        every = np.broadcast_to(np.arange(first), (first, first))
        graph.edges[:first] = robust_prune(points, np.arange(first), every.copy(), degree, relaxed)
    at = first
    while at < n:
        new = np.arange(at, min(n, at + min(BATCH, at)))
        ids, _, _ = graph.search(points[new], beam, at)
        among = np.where(new[None, :] != new[:, None], new[None, :], -1)
        near = np.argsort(-(points[new] @ points[new].T), axis=1, kind="stable")[:, : degree // 2 + 1]
        candidates = np.concatenate([ids, np.take_along_axis(among, near, 1)], axis=1)
        kept = robust_prune(points, new, candidates, degree, relaxed)
        graph.edges[new] = kept
        _linked_back(graph, new, kept, degree, relaxed)
        at += len(new)
    return graph
