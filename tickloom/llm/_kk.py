"""Karmarkar-Karp multiway differencing over token pieces (pure Python, no Spark)."""

from __future__ import annotations

import heapq
from bisect import insort


def differencing(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """Splits items into ``k`` subsets of near-equal sums by multiway differencing.

    A partial partition is kept sparse, as its non-empty subsets sorted by sum; the missing ones are zeros.
    The two partial partitions of the largest imbalance are merged until one is left: the largest subset of
    the one joins the smallest of the other, so that opposing imbalances cancel.
    Returns ``(sum, item indexes)`` for each non-empty subset.
    """
    if not sizes:
        return []
    if k <= 1:
        return [(sum(sizes), list(range(len(sizes))))]
    # heap entry: (-imbalance, tie-break, [(sum, serial, members)] in ascending order); members is a nested pair
    heap = [(-s, i, [(s, i, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        p, q = len(a), len(b)
        if q == 1 and p == k:
            s, n, m = a.pop(0)
            insort(a, (s + b[0][0], n, (m, b[0][2])))
            merged = a
        elif p + q <= k:
            merged = sorted(a + b)
        else:
            # rank r of k (ascending, zeros first) of a meets rank k-1-r of b
            met = p + q - k
            merged = a[met:] + b[met:]
            for r in range(met):
                (s, n, m), (t, _, o) = a[r], b[met - 1 - r]
                merged.append((s + t, n, (m, o)))
            merged.sort()
        serial += 1
        low = merged[0][0] if len(merged) == k else 0
        heapq.heappush(heap, (low - merged[-1][0], serial, merged))
    return [(s, _flat(m)) for s, _, m in heap[0][2]]


def _flat(members) -> list[int]:
    out, todo = [], [members]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            todo.extend(x)
        else:
            out.append(x)
    return out


def windows(sizes: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """Near-equal windows of at most ``capacity``; their count rises whenever that is exceeded."""
    if not sizes:
        return []
    if max(sizes) > capacity:
        raise ValueError("an item exceeds the capacity")
    k = -(-sum(sizes) // capacity)
    while True:
        found = differencing(sizes, k)
        if max(s for s, _ in found) <= capacity:
            return found
        k += 1
