"""Exact minimum cuts of sparse graphs by Dinic's maximum flow, with integer capacities."""

from __future__ import annotations

from collections import deque


def min_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """For each node whether it stays on the source's side of a minimum cut.

    ``source[i]`` and ``sink[i]`` are the capacities from the source to i and from i to the sink; an edge (a, b, capacity)
    holds both ways. Of several minimum cuts, the one with the fewest nodes on the source's side.
    """
    n = len(source)
    through = [a - b for a, b in zip(source, sink, strict=True)]  # what min(a, b) carries needs no search
    if not any(t < 0 for t in through):
        return [t > 0 for t in through] if not edges else _reached(n, through, edges)
    return _reached(n, through, edges)


def _reached(n: int, through: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    out: list[list[int]] = [[] for _ in range(n)]  # edges by place; edge e runs to to[e], its partner is e ^ 1
    to: list[int] = []
    room: list[int] = []
    for a, b, capacity in edges:
        if capacity > 0 and a != b:
            out[a].append(len(to))
            out[b].append(len(to) + 1)
            to += (b, a)
            room += (capacity, capacity)
    give, take = [max(t, 0) for t in through], [max(-t, 0) for t in through]
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if give[i])
        for i in queue:
            level[i] = 0
        ends = False
        while queue:
            i = queue.popleft()
            ends = ends or take[i] > 0
            for e in out[i]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not ends:
            return [x >= 0 for x in level]
        at = [0] * n
        for start in range(n):
            while give[start] and _push(start, give, take, out, to, room, level, at):
                pass


def _push(start: int, give: list[int], take: list[int], out: list[list[int]], to: list[int], room: list[int], level: list[int], at: list[int]) -> bool:
    """Sends flow along one shortest path from ``start``, if there is one left."""
    path: list[int] = []
    i = start
    while True:
        if take[i]:
            amount = min([give[start], take[i], *(room[e] for e in path)])
            give[start] -= amount
            take[i] -= amount
            for e in path:
                room[e] -= amount
                room[e ^ 1] += amount
            return True
        while at[i] < len(out[i]):
            e = out[i][at[i]]
            if room[e] and level[to[e]] == level[i] + 1:
                break
            at[i] += 1
        if at[i] < len(out[i]):
            path.append(out[i][at[i]])
            i = to[path[-1]]
        elif path:
            e = path.pop()
            i = to[e ^ 1]
            at[i] += 1
        else:
            return False
