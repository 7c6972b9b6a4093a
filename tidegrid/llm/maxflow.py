"""Minimum cuts of small graphs by augmenting along level graphs."""

from __future__ import annotations

from collections import deque


def minimum_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """For each node, whether it stays on the source's side of a minimum cut.

    source[i] and sink[i] are capacities from the source to node i and from it to the sink; an edge (i, j, c) has capacity c
    in both directions. Of several minimum cuts it is the one with the fewest nodes on the source's side.
    """
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in range(n):
        through = min(source[i], sink[i])  # flows straight through the node
        if source[i] > through:
            join(s, i, source[i] - through, 0)
        elif sink[i] > through:
            join(i, t, sink[i] - through, 0)
    for i, j, c in edges:
        if c > 0:
            join(i, j, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        while True:  # one path after the other through the level graph, without recursion
            path: list[int] = []
            a = s
            while a != t:
                while at[a] < len(out[a]):
                    e = out[a][at[a]]
                    if room[e] > 0 and level[to[e]] == level[a] + 1:
                        break
                    at[a] += 1
                if at[a] == len(out[a]):
                    if not path:
                        break
                    a = to[path.pop() ^ 1]
                    at[a] += 1
                    continue
                path.append(out[a][at[a]])
                a = to[path[-1]]
            if a != t:
                break
            flow = min(room[e] for e in path)
            for e in path:
                room[e] -= flow
                room[e ^ 1] += flow
