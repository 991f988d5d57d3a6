"""How many nodes of each class lie within 1, 2 and 3 steps of each node, by bit maps instead of pairs.

A block is a set of nodes of one class that are sought. Every node near it has a map with one bit for each of them: within
one step the bits of its neighbours, within one more the maps of its neighbours put together, and so on; what is counted
are bits. So the work is links times nodes over 64, however many pairs are in reach.

Nodes sought that share a neighbour, the hub, stand in blocks of their own: the hub's neighbours reach all of them in two
steps and whoever is within two steps of it in three, so only the maps of the few other nodes are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Nodes sought at once, at most; smaller groups of one hub share blocks. Bytes of a block's maps: blocks with more are halved.
WIDTH, SHARED, BYTES = 2_048, 256, 64_000_000
#: Rows that are put together at once, and from how many neighbours on a row is for itself.
TILE, LONG = 8_192, 48

LOW = (1 << 32) - 1


class Graph:
    """Neighbours of nodes 0 to n - 1, each node among its own. links: a << 32 | b, each pair once."""

    def __init__(self, n: int, links: np.ndarray) -> None:
        loops = links[(links >> 32) == (links & LOW)] & LOW
        links = links[(links >> 32) != (links & LOW)]
        ends = np.empty(2 * len(links) + n, np.int64)  # filled in place, as this is what takes most memory
        back = ends[len(links) : 2 * len(links)]
        ends[: len(links)] = links
        np.left_shift(links, 32, out=back)
        links >>= 32
        back |= links
        ends[2 * len(links) :] = np.arange(n, dtype=np.int64) * ((1 << 32) + 1)
        ends.sort()
        self.n, self.to = n, (ends & LOW).astype(np.int32)
        ends >>= 32
        self.degree = np.bincount(ends, minlength=n)
        self.start = np.concatenate([[0], np.cumsum(self.degree)])
        self.looped = np.zeros(n, bool)
        self.looped[loops] = True

    def around(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours of some nodes, one node after the other, and how many each has."""
        many = self.degree[rows]
        return self.to[np.repeat(self.start[rows] - np.cumsum(many) + many, many) + np.arange(many.sum())], many

    def beside(self, rows: np.ndarray) -> np.ndarray:
        """Whether each node is a neighbour of some nodes."""
        mark = np.zeros(self.n, bool)
        for i in range(0, len(rows), TILE):
            mark[self.around(rows[i : i + TILE])[0]] = True
        return mark

    def best(self) -> np.ndarray:
        """Of each node the neighbour, or itself, with the most neighbours."""
        return (np.maximum.reduceat((self.degree << 32 | np.arange(self.n))[self.to], self.start[:-1]) & LOW).astype(np.int64)


def blocks(graph: Graph, kinds: np.ndarray, width: int, shared: int) -> list[tuple[np.ndarray, int]]:
    """All nodes in blocks of one kind, each with the neighbour that all of the block share, or -1."""
    best = graph.best()
    root = best
    while not np.array_equal(root, best[root]):
        root = best[root]
    order = np.lexsort((best, kinds, root))
    cuts = np.flatnonzero((np.diff(best[order]) != 0) | (np.diff(kinds[order]) != 0)) + 1
    ends = np.concatenate([[0], cuts, [graph.n]])
    large = np.repeat(np.diff(ends) >= shared, np.diff(ends))
    out = [(order[i : min(i + width, end)], int(best[order[at]])) for at, end in zip(ends[:-1], ends[1:], strict=True) if end - at >= shared for i in range(at, end, width)]
    for kind in range(3):
        rest = order[~large & (kinds[order] == kind)]
        out += [(rest[i : i + width], -1) for i in range(0, len(rest), width)]
    return sorted(out, key=lambda x: root[x[0][0]])


def _tiles(graph: Graph, bits: np.ndarray, place: np.ndarray, rows: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """The maps of some nodes, put together from those that neighbours have at their place in bits (0: none)."""
    for first in range(0, len(rows), TILE):
        nodes, many = graph.around(rows[first : first + TILE])
        at = place[nodes]
        there = at > 0
        many = np.add.reduceat(there, np.cumsum(many) - many, dtype=np.int64)
        at = at[there]
        order = np.argsort(-many, kind="stable")
        begin, sizes = (np.cumsum(many) - many)[order], many[order]
        out = np.zeros((len(many), bits.shape[1]), np.uint64)
        apart = int(np.searchsorted(-sizes, -LONG))
        for i in range(apart):
            for j in range(begin[i], begin[i] + sizes[i], TILE):
                out[i] |= np.bitwise_or.reduce(bits[at[j : min(j + TILE, begin[i] + sizes[i])]], axis=0)
        for k in range(int(sizes[apart]) if apart < len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -k))
            out[apart:live] |= bits[at[begin[apart:live] + k]]
        whole = np.empty_like(out)
        whole[order] = out
        yield slice(first, first + len(many)), whole


def _ones(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=1, dtype=np.int32)


def counts(graph: Graph, kinds: np.ndarray, far: int, part: int = 0, parts: int = 1, width: int = WIDTH, shared: int = SHARED, size: int = BYTES) -> np.ndarray:
    """found[h, kind, node]: nodes of the kind exactly h + 1 steps away; linked with itself, a node is one step away.

    kinds: 0, 1 or 2. Only the blocks of one of the parts are sought; the sum over all parts is the whole.
    """
    within = np.zeros((far, 3, graph.n), np.int32)
    place = np.zeros(graph.n, np.int32)
    known, near, nearby = -1, np.array([], np.int64), np.zeros(graph.n, bool)
    every = blocks(graph, kinds, width, shared)
    mine = every[len(every) * part // parts : len(every) * (part + 1) // parts]
    ahead = mine[::-1]
    while ahead:
        sought, hub = ahead.pop()
        kind, words = kinds[sought[0]], -(-len(sought) // 64)
        nodes, many = graph.around(sought)
        column = np.repeat(np.arange(len(sought)), many)
        mark = np.zeros(graph.n, bool)
        mark[nodes] = True
        rows = np.flatnonzero(mark)
        if hub >= 0 and hub != known:
            known, near = hub, graph.around(np.array([hub]))[0]
            nearby = graph.beside(near)
        reached = graph.beside(rows)
        if words > 1 and (np.count_nonzero(reached) - (len(near) if hub >= 0 else 0)) * words * 8 > size:
            half = words // 2 * 64
            ahead += [(sought[half:], hub), (sought[:half], hub)]
            continue
        place[rows] = np.arange(1, len(rows) + 1)
        bits = np.zeros((len(rows) + 1, words), np.uint64)
        np.bitwise_or.at(bits.reshape(-1), place[nodes].astype(np.int64) * words + (column >> 6), np.left_shift(np.uint64(1), (column & 63).astype(np.uint64)))
        within[0, kind, rows] += _ones(bits[1:])
        for h in range(1, far):
            reached = reached if h == 1 else graph.beside(rows)
            if hub >= 0:  # these have all bits: neighbours of the hub in the second step, theirs in the third
                full = near if h == 1 else np.flatnonzero(nearby)
                within[h, kind, full] += len(sought)
                reached[full] = False
            more = np.flatnonzero(reached)
            keep = h + 1 < far
            maps = np.zeros((len(more) + 1 if keep else 1, words), np.uint64)
            for where, some in _tiles(graph, bits, place, more):
                within[h, kind, more[where]] += _ones(some)
                if keep:
                    maps[1:][where] = some
            place[rows] = 0
            if keep:
                place[more] = np.arange(1, len(more) + 1)
                rows, bits = more, maps
        place[rows] = 0
    for h in range(far - 1, 0, -1):
        within[h] -= within[h - 1]
    own = np.concatenate([b for b, _ in mine] or [np.array([], np.int64)])
    own = own[~graph.looped[own]]
    within[0, kinds[own], own] -= 1
    return within
