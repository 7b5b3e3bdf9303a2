"""Packing plans over a histogram of lengths: their size depends on the capacity, not on the number of pieces."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np


def _price(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits: value and how often each size is in it."""
    depth = capacity // int(sizes.min())
    best, picks = np.zeros(capacity + 1), []
    for _ in range(depth):
        nxt, pick = best.copy(), np.full(capacity + 1, -1)
        for i, s in enumerate(sizes):
            got = np.full(capacity + 1, -1.0)
            got[s:] = best[: capacity + 1 - s] + values[i]
            better = got > nxt + 1e-12
            nxt[better], pick[better] = got[better], i
        picks.append(pick)
        if (pick < 0).all():
            break
        best = nxt
    counts, room = np.zeros(len(sizes), int), capacity
    for pick in reversed(picks):
        if (i := pick[room]) >= 0:
            counts[i] += 1
            room -= int(sizes[i])
    return float(counts @ values), counts


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Whole multiples of the configurations in an optimal fractional cover of counts, found by column generation."""
    k = len(sizes)
    basis = np.diag([capacity // int(s) for s in sizes]).astype(float)
    for _ in range(rounds):
        value, column = _price(sizes, np.linalg.solve(basis.T, np.ones(k)), capacity)
        if value <= 1 + 1e-9:
            break
        x, d = np.linalg.solve(basis, counts.astype(float)), np.linalg.solve(basis, column.astype(float))
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.linalg.solve(basis, counts.astype(float))
    return [(basis[:, j].round().astype(int), int(np.floor(x[j] + 1e-9))) for j in range(k) if x[j] >= 1 - 1e-9]


def plan(histogram: dict[int, int], capacity: int, groups: int = 40, small: int = 8) -> dict[str, np.ndarray]:
    """A packing of all pieces of a histogram {length: count} into sequences of the given capacity.

    Pieces over capacity / small are large: in falling order they fall into groups of equal cardinality, each rounded up to its
    longest; configurations of the rounded sizes are optimised; the pieces themselves take the places of their groups; those left
    over and the small ones go, longest first, where they fit best. Returns slots sorted by length and rank: pieces
    rank_from, rank_from + 1, ... of that length lie at offset in sequences seq, seq + 1, ...
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    assert all(0 < n <= capacity for n in left), "lengths must be from 1 to the capacity"
    bins: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # by room left: (how many sequences, lengths in them)
    rooms: list[int] = []

    def put(room: int, many: int, items: tuple[int, ...]) -> None:
        if many:
            if room not in bins:
                insort(rooms, room)
            bins.setdefault(room, []).append((many, items))

    put(0, left.pop(capacity, 0), (capacity,))
    large = sorted((n for n in left if n > capacity // small), reverse=True)
    if total := sum(left[n] for n in large):
        each, runs = -(-total // min(groups, total)), [[]]
        for n in large:
            c = left[n]
            while c:
                if (have := sum(x for _, x in runs[-1])) == each:
                    runs.append([])
                    have = 0
                runs[-1].append((n, take := min(c, each - have)))
                c -= take
        longest: dict[int, list[tuple[int, int]]] = {}
        for r in runs:  # groups of one size are one
            longest.setdefault(r[0][0], []).extend(r)
        sizes = np.array(list(longest))
        queues = [r[::-1] for r in longest.values()]
        for column, many in configurations(sizes, np.array([sum(c for _, c in q) for q in queues]), capacity):
            slots = [i for i, a in enumerate(column) for _ in range(a)]
            while many:
                held, got = [], many
                need: dict[int, int] = {}
                for i in slots:
                    need[i] = need.get(i, 0) + 1
                for i, a in need.items():  # as many sequences as take the same lengths
                    while queues[i] and queues[i][-1][1] == 0:
                        queues[i].pop()
                    if queues[i]:
                        got = min(got, max(1, queues[i][-1][1] // a))
                for i in slots:
                    while queues[i] and queues[i][-1][1] == 0:
                        queues[i].pop()
                    if queues[i] and queues[i][-1][1] >= got:
                        n, c = queues[i][-1]
                        queues[i][-1] = (n, c - got)
                        left[n] -= got
                        held.append(n)
                put(capacity - sum(held), got if held else 0, tuple(held))
                many -= got
    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            if (at := bisect_left(rooms, n)) < len(rooms):
                room = rooms[at]
                many, items = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[at]
                take = min(c, many)
                put(room, many - take, items)
                put(room - n, take, (*items, n))
                c -= take
            else:
                fit = capacity // n
                put(capacity - fit * n, c // fit, (n,) * fit)
                put(capacity - c % fit * n, bool(c % fit), (n,) * (c % fit))
                c = 0
    slots, used, seq = [], {}, 0
    for held in bins.values():
        for many, items in held:
            offset = 0
            for n in items:
                slots.append((n, used.get(n, 0), seq, offset))
                used[n] = used.get(n, 0) + many
                offset += n
            seq += many
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank_from": table[:, 1], "seq": table[:, 2], "offset": table[:, 3], "sequences": np.array([seq])}


def best_plan(histogram: dict[int, int], capacity: int, groups: int = 100, thresholds: tuple[int, ...] = (2, 4, 8)) -> dict[str, np.ndarray]:
    """The plan with the fewest sequences over several bounds of what counts as large."""
    return min((plan(histogram, capacity, groups, t) for t in thresholds), key=lambda p: int(p["sequences"][0]))
