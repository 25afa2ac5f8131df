"""Hierarchical navigable small-world graphs over the rows of one shard, as flat neighbour arrays.

Nodes are numbered from the highest level down, so that the nodes of a level are a prefix
of those below it and each level is one array (nodes x links, -1 where free). Levels are
built from the top, in batches: a batch of nodes looks for its neighbours among those that
are linked already and among itself, all at once.

Largest inner product is searched as nearness on a sphere: each vector gets one more
component that brings all to the same length; a query gets a zero there.
"""

from __future__ import annotations

import numpy as np

from .textkit import U, mix

#: Links a new node asks for; level 0 keeps twice as many. Nodes looked at while building and while searching.
LINKS = 20
BUILD = 96
SEARCH = 160
BATCH = 512
#: Open nodes of a beam that are expanded at once; neighbours of the same batch, and new links of one node, that are weighed.
WIDTH = 4
NEARBY = 64


def lifted(v: np.ndarray) -> np.ndarray:
    """Rows over the longest row's length, with the component that makes all of length 1."""
    size = np.abs(v).max(initial=0.0)
    v = v / size if size else v
    norm = np.einsum("nd,nd->n", v, v)
    top = norm.max(initial=0.0)
    return (np.c_[v, np.sqrt(np.maximum(top - norm, 0))] / np.sqrt(top or 1)).astype(np.float32)


def asking(q: np.ndarray) -> np.ndarray:
    """Queries of length 1 in the space of :func:`lifted`."""
    q = q / np.maximum(np.abs(q).max(1, keepdims=True, initial=0), np.finfo(float).tiny)
    return np.c_[q / np.sqrt(np.maximum(np.einsum("nd,nd->n", q, q), np.finfo(float).tiny))[:, None], np.zeros(len(q))].astype(np.float32)


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, nearness), ``ef`` for each query, -1 and -inf where fewer are reached: best-first search of all queries in step."""
    n, b = len(q), np.arange(len(q))
    seen = np.zeros((n, len(x)), bool)
    ids = np.full((n, ef), -1, np.int32)
    sims = np.full((n, ef), -np.inf, np.float32)
    todo = np.full((n, ef), -np.inf, np.float32)  # nearness of those not expanded yet
    ids[:, 0] = entry
    sims[:, 0] = todo[:, 0] = np.einsum("nd,nd->n", x[entry], q)
    seen[b, entry] = True
    live, width = b, min(WIDTH, ef)
    while len(live):
        near = todo[live]
        pick = np.argpartition(-near, width - 1, axis=1)[:, :width]
        rows = np.arange(len(live))[:, None]
        good = near[rows, pick] > -np.inf
        some = good.any(1)
        live, pick, good, near = live[some], pick[some], good[some], near[some]
        if not len(live):
            break
        rows = np.arange(len(live))[:, None]
        near[rows, pick] = -np.inf
        own = ids[live]
        found = np.full((len(live), width * links.shape[1]), -1, np.int32)
        for j in range(width):
            to = np.where(good[:, j : j + 1], links[own[rows[:, 0], pick[:, j]]], -1)
            fresh = (to >= 0) & ~seen[live[:, None], to]
            r, c = np.nonzero(fresh)
            seen[live[r], to[r, c]] = True
            found[r, j * links.shape[1] + c] = to[r, c]
        r, c = np.nonzero(found >= 0)
        new = np.full(found.shape, -np.inf, np.float32)
        new[r, c] = np.einsum("nd,nd->n", x[found[r, c]], q[live[r]])
        all_sims, all_ids, all_todo = np.concatenate([sims[live], new], 1), np.concatenate([own, found], 1), np.concatenate([near, new], 1)
        best = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
        sims[live], ids[live], todo[live] = all_sims[rows, best], all_ids[rows, best], all_todo[rows, best]
    return ids, sims


def _spread(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """``m`` of the candidates of each row, -1 where fewer: first those nearer to the row's node than to any taken before, then the nearest others."""
    order = np.argsort(-sims, axis=1, kind="stable")
    rows = np.arange(len(ids))[:, None]
    ids, sims = ids[rows, order], sims[rows, order]
    own = x[ids]
    between = np.matmul(own, own.transpose(0, 2, 1))
    blocked = np.full(ids.shape, -np.inf, np.float32)
    taken = np.zeros(ids.shape, bool)
    n = np.zeros(len(ids), np.int64)
    for j in range(ids.shape[1]):
        now = np.flatnonzero((ids[:, j] >= 0) & (n < m) & (sims[:, j] > blocked[:, j]))
        taken[now, j] = True
        n[now] += 1
        blocked[now] = np.maximum(blocked[now], between[now, j])
    rank = np.where(ids < 0, 2, np.where(taken, 0, 1))
    order = np.argsort(rank, axis=1, kind="stable")[:, :m]
    out = ids[rows, order]
    return out if out.shape[1] == m else np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)


def _link(x: np.ndarray, links: np.ndarray, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> None:
    """Links ``nodes`` to chosen candidates, and those back; a node with too many keeps a spread choice."""
    own = _spread(x, ids, sims, m)
    links[nodes, :m] = own
    r, c = np.nonzero(own >= 0)
    to, back = own[r, c].astype(np.int64), nodes[r].astype(np.int32)
    near = np.einsum("nd,nd->n", x[to], x[back])
    order = np.lexsort((back, -near, to))
    to, back = to[order], back[order]
    hosts, first, count = np.unique(to, return_index=True, return_counts=True)
    place = np.arange(len(to)) - np.repeat(first, count)
    row = np.repeat(np.arange(len(hosts)), count)
    keep = place < NEARBY
    more = np.full((len(hosts), min(int(count.max(initial=0)), NEARBY)), -1, np.int32)
    more[row[keep], place[keep]] = back[keep]
    for at in range(0, len(hosts), 1024):
        h, add = hosts[at : at + 1024], more[at : at + 1024]
        old = links[h]
        add = np.where((add[:, :, None] == old[:, None, :]).any(2), -1, add)  # both ends may have asked
        cand = np.concatenate([old, add], 1)
        full = (cand >= 0).sum(1) > links.shape[1]
        slack = cand[~full]
        links[h[~full]] = slack[np.arange(len(slack))[:, None], np.argsort(slack < 0, axis=1, kind="stable")][:, : links.shape[1]]
        if full.any():
            h, cand = h[full], cand[full]
            width = int((cand >= 0).sum(1).max())
            cand = cand[np.arange(len(cand))[:, None], np.argsort(cand < 0, axis=1, kind="stable")][:, :width]
            sims = np.where(cand >= 0, np.matmul(x[cand], x[h][:, :, None])[:, :, 0], -np.inf)
            links[h] = _spread(x, cand, sims, links.shape[1])


def _level(x: np.ndarray, width: int, entry: np.ndarray) -> np.ndarray:
    n = len(x)
    links = np.full((n, width), -1, np.int32)
    m = min(LINKS, width)
    done = min(n, BATCH // 2)
    sims = x[:done] @ x[:done].T
    np.fill_diagonal(sims, -np.inf)
    if done > 1:
        near = np.argsort(-sims, axis=1, kind="stable")[:, : min(BUILD, done - 1)].astype(np.int32)
        _link(x, links, np.arange(done), near, np.take_along_axis(sims, near, 1), m)
    while done < n:
        nodes = np.arange(done, min(n, done + min(BATCH, done)))
        at = entry[nodes]
        ids, sims = beam(x[:done], links[:done], x[nodes], np.where(at < done, at, 0), min(BUILD, done))
        ids = np.where(sims > -np.inf, ids, -1)
        among = x[nodes] @ x[nodes].T
        np.fill_diagonal(among, -np.inf)
        if len(nodes) > 1:
            k = min(len(nodes) - 1, m)
            near = np.argpartition(-among, k - 1, axis=1)[:, :k]
            ids = np.concatenate([ids, nodes[near].astype(np.int32)], 1)
            sims = np.concatenate([sims, np.take_along_axis(among, near, 1)], 1)
        k = min(NEARBY, ids.shape[1])
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        _link(x, links, nodes, np.take_along_axis(ids, near, 1), np.take_along_axis(sims, near, 1), m)
        done = int(nodes[-1]) + 1
    return links


def order_and_sizes(keys: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The order in which rows become nodes, and how many nodes each level has; levels are drawn from a hash of ``keys``."""
    draw = mix(keys.astype(np.int64).view(U) + U(0x5851F42D4C957F2D))
    u = (draw >> U(11)).astype(np.float64) / 2.0**53
    level = np.floor(-np.log(np.maximum(u, 2.0**-53)) / np.log(LINKS)).astype(np.int64)
    order = np.lexsort((draw, -level))
    return order, [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]


def build(x: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Link arrays, level 0 first, for nodes ``x`` in the order of :func:`order_and_sizes`."""
    levels: list[np.ndarray] = []
    for k in range(len(sizes) - 1, -1, -1):
        n = sizes[k]
        entry = np.concatenate([descend(x, levels, x[at : at + 4096]) for at in range(0, n, 4096)]) if n else np.zeros(0, np.int64)
        levels.insert(0, _level(x[:n], LINKS * (2 if k == 0 else 1), entry))
    return levels


def descend(x: np.ndarray, levels: list[np.ndarray], q: np.ndarray) -> np.ndarray:
    """The node that each query reaches by going down ``levels``, the last of which is the highest."""
    at = np.zeros(len(q), np.int64)
    for links in reversed(levels):
        ids, sims = beam(x[: len(links)], links, q, at, 1)
        at = ids[:, 0].astype(np.int64)
    return at


def search(x: np.ndarray, levels: list[np.ndarray], q: np.ndarray, ef: int = SEARCH) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, nearness) that a beam of ``ef`` reaches on level 0."""
    return beam(x, levels[0], q, descend(x, levels[1:], q), min(ef, len(x)))
