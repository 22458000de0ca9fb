"""A hierarchical navigable small-world graph over 64-bit hashes, in flat arrays, built and searched in lock step.

Nodes are numbered 0..n-1 by the caller's tie order, so distances tie in that order everywhere. Layer 0
holds all nodes, each higher layer about one in `fan` of the one below, chosen by a hash of the value, so
the same values give the same graph. A layer is one int32 array of neighbours (-1: none), row by row; the
rows of higher layers belong to the nodes in `members`.

All operations take many queries at once: a beam of (distance, node, expanded) keys per query, packed
into int64 and kept sorted, is advanced by expanding its nearest unexpanded nodes in every row together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

_FAR = np.int64(1) << np.int64(60)
_SHIFT = np.int64(40)
_ONE = np.int64(1)
_CLOSE = 20
_MASK = (np.int64(1) << np.int64(39)) - np.int64(1)


def _keys(dist: np.ndarray, node: np.ndarray) -> np.ndarray:
    return (dist.astype(np.int64) << _SHIFT) | (node.astype(np.int64) << _ONE)


def _nodes(keys: np.ndarray) -> np.ndarray:
    return (keys >> _ONE) & _MASK


def _merge(keys: np.ndarray, width: int) -> np.ndarray:
    """Sorted rows without repeated nodes, the expanded one of a repeat kept, cut to width."""
    if keys.shape[1] <= width:
        keys = np.concatenate([keys, np.full((len(keys), 1), _FAR)], axis=1)
    keys.sort(axis=1)
    # In one line, as it lies in memory: a row's last key is compared with the next row's first, but the last is cut anyway.
    line = keys.ravel()
    bare = line >> _ONE
    np.putmask(line[:-1], bare[:-1] == bare[1:], _FAR)
    keys.sort(axis=1)
    return np.ascontiguousarray(keys[:, :width])


@dataclass
class Layer:
    neighbours: np.ndarray
    slot: np.ndarray | None  # node to row; None: the row is the node


@dataclass
class Graph:
    values: np.ndarray
    layers: list[Layer] = field(default_factory=list)
    top: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def size(self) -> int:
        return sum(x.neighbours.nbytes for x in self.layers) + self.values.nbytes


def _advance(g: Graph, layer: Layer, queries: np.ndarray, beam: np.ndarray, width: int, wide: int = 3) -> np.ndarray:
    """Runs beams (sorted keys) in one layer until every node in every beam is expanded."""
    degree = layer.neighbours.shape[1]
    out = beam
    live = np.arange(len(beam))
    work, q = beam, queries
    while len(live):
        open_ = (work & _ONE) == 0
        open_ &= work < _FAR
        rank = np.cumsum(open_, axis=1, dtype=np.int8 if open_.shape[1] < 128 else np.int64)
        pick = open_ & (rank <= wide)
        count = np.minimum(rank[:, -1], wide)
        busy = count > 0
        if not busy.all():
            out[live[~busy]] = work[~busy]
            live, work, q, pick, count = live[busy], work[busy], q[busy], pick[busy], count[busy]
            if not len(live):
                break
            rank = rank[busy]
        nodes = np.full((len(live), wide), -1, np.int64)
        flat = np.flatnonzero(pick)
        taken = work.ravel()[flat]
        nodes.ravel()[flat // pick.shape[1] * wide + rank.ravel()[flat] - 1] = _nodes(taken)
        work.ravel()[flat] = taken | _ONE
        row = nodes if layer.slot is None else layer.slot[nodes]
        near = layer.neighbours[row].reshape(len(live), wide * degree)
        bad = (near < 0) | np.repeat(nodes < 0, degree, axis=1)
        fresh = _keys(np.bitwise_count(g.values.take(near, mode="wrap") ^ q[:, None]), near)
        fresh[bad] = _FAR
        work = _merge(np.concatenate([work, fresh], axis=1), width)
    return out


def search(g: Graph, queries: np.ndarray, width: int, upper: int = 4, down_to: int = 0, chunk: int = 1024) -> np.ndarray:
    """Sorted keys (distance, node) of about `width` nearest nodes of each query hash, found by descending the layers.

    Queries go `chunk` at a time, so that the arrays of a step stay in the processor's cache.
    """
    n = len(queries)
    if n > chunk:
        return np.concatenate([search(g, queries[i : i + chunk], width, upper, down_to, chunk) for i in range(0, n, chunk)])
    top = _keys(np.bitwise_count(g.values[g.top][None, :] ^ queries[:, None]), np.broadcast_to(g.top, (n, len(g.top))))
    beam = _merge(top, width if len(g.layers) <= down_to else upper)
    for depth in range(len(g.layers) - 1, down_to - 1, -1):
        w = width if depth == down_to else upper
        if beam.shape[1] < w:
            beam = np.concatenate([beam, np.full((n, w - beam.shape[1]), _FAR)], axis=1)
        beam = _advance(g, g.layers[depth], queries, beam[:, :w] & ~_ONE, w)
    return beam & ~_ONE


def _select(g: Graph, keys: np.ndarray, degree: int) -> np.ndarray:
    """Neighbours out of sorted candidate keys: those nearer to the node than to any one chosen before, then the nearest others."""
    n, m = keys.shape
    real = keys < _FAR
    vals = np.ascontiguousarray(g.values[np.where(real, _nodes(keys), 0)].T)
    dist = np.ascontiguousarray(np.where(real, keys >> _SHIFT, 0).astype(np.uint8).T)
    picked = np.zeros((m, n), bool)
    picked[0] = True
    for j in range(1, m):
        near = np.bitwise_count(vals[:j] ^ vals[j]) < dist[j]
        near &= picked[:j]
        np.logical_not(near.any(0), out=picked[j])
    chosen = picked.T & real
    chosen &= np.cumsum(chosen, axis=1) <= degree * 2 // 3
    order = np.where(chosen, keys, keys + (np.int64(1) << np.int64(58)))
    order[keys >= _FAR] = _FAR
    order.sort(axis=1)
    best = order[:, :degree]
    ids = np.where(best < _FAR, _nodes(best), -1).astype(np.int32)
    if ids.shape[1] < degree:
        ids = np.concatenate([ids, np.full((n, degree - ids.shape[1]), -1, np.int32)], axis=1)
    return ids


def _link(g: Graph, layer: Layer, nodes: np.ndarray, chosen: np.ndarray, spare: int) -> None:
    """Adds the reverse of each link, choosing anew where a node has more neighbours than places."""
    degree = layer.neighbours.shape[1]
    to = chosen.ravel()
    frm = np.repeat(nodes, chosen.shape[1])
    ok = to >= 0
    to, frm = to[ok].astype(np.int64), frm[ok]
    d = np.bitwise_count(g.values[to] ^ g.values[frm])
    # One key: target, distance, source (a graph has fewer than 2^28 nodes).
    packed = np.sort((to << np.int64(35)) | (d.astype(np.int64) << np.int64(28)) | frm)
    to, d, frm = packed >> np.int64(35), (packed >> np.int64(28)) & np.int64(127), packed & np.int64((1 << 28) - 1)
    head = np.ones(len(to), bool)
    head[1:] = to[1:] != to[:-1]
    start = np.flatnonzero(head)
    place = np.arange(len(to)) - np.repeat(start, np.diff(np.append(start, len(to))))
    few = place < spare
    targets = to[start]
    extra = np.full((len(targets), spare), _FAR)
    extra[(np.cumsum(head) - 1)[few], place[few]] = _keys(d[few], frm[few])
    rows = targets if layer.slot is None else layer.slot[targets]
    have = layer.neighbours[rows]
    old = _keys(np.bitwise_count(g.values[have] ^ g.values[targets][:, None]), have)
    old[have < 0] = _FAR
    both = _merge(np.concatenate([old, extra], axis=1), degree + spare)
    full = both[:, degree] < _FAR
    simple = np.where(both[:, :degree] < _FAR, _nodes(both[:, :degree]), -1).astype(np.int32)
    if full.any():
        simple[full] = _select(g, both[full], degree)
    layer.neighbours[rows] = simple


def build(values: np.ndarray, degree: int = 24, width: int = 32, fan: int = 16, batch: int = 2048, top: int = 64) -> Graph:
    """The graph over distinct hashes (uint64, in tie order)."""
    n = len(values)
    g = Graph(values)
    if not n:
        return g
    mixed = (values * np.uint64(0x9E3779B97F4A7C15)) ^ (values >> np.uint64(29))
    order = np.argsort(mixed * np.uint64(0xBF58476D1CE4E5B9), kind="stable")  # any fixed shuffle
    sizes = [n]
    while sizes[-1] > top:
        sizes.append(max(top, sizes[-1] // fan))
    g.top = np.sort(order[: sizes[-1]])
    layers: list[Layer] = []
    for size in reversed(sizes[:-1]):
        members = order[:size]
        slot = None
        if size < n:
            slot = np.zeros(n, np.int32)
            slot[members] = np.arange(size, dtype=np.int32)
        layer = Layer(np.full((size, degree), -1, np.int32), slot)
        first = len(g.top) if not layers else layers[-1].neighbours.shape[0]
        # The layer above is a part of this one: its nodes are linked first, by what is nearest among themselves.
        at = 0
        while at < size:
            stop = min(size, max(at + min(batch, max(at, first)), at + 1))
            nodes = members[at:stop]
            q = values[nodes]
            own = np.bitwise_count(q[:, None] ^ q[None, :])
            np.fill_diagonal(own, 255)
            found = []
            if not at:
                k = min(width, len(nodes) - 1)
                if k > 0:
                    code = (own.astype(np.int64) << _SHIFT) | (nodes.astype(np.int64) << _ONE)[None, :]
                    found.append(np.sort(code, axis=1)[:, :k])
            else:
                # Nodes that arrive together meet here, if they are close, the nearest of them first; the graph has the rest.
                r, c = np.nonzero(own <= _CLOSE)
                if len(r):
                    # One key: row, then distance and node as in _keys.
                    code = np.sort((r << np.int64(48)) | _keys(own[r, c], nodes[c]))
                    r, code = code >> np.int64(48), code & ((_ONE << np.int64(48)) - _ONE)
                    rank = np.arange(len(r)) - np.searchsorted(r, r)
                    few = rank < width
                    near = np.full((len(nodes), int(rank[few].max()) + 1), _FAR)
                    near[r[few], rank[few]] = code[few]
                    found.append(near)
            if at:
                part = Graph(values, [layer, *reversed(layers)], g.top)
                found.append(search(part, q, width))
            if found:
                keys = _merge(np.concatenate(found, axis=1), width)
                chosen = _select(g, keys, degree)
                layer.neighbours[nodes if slot is None else slot[nodes]] = chosen
                _link(g, layer, nodes, chosen, 8)
            at = stop
        layers.append(layer)
        g.layers = list(reversed(layers))
    return g
