"""Brute-force helpers of these tests."""

from __future__ import annotations

LAST = (1 << 63) - 1


def reachable(nodes, links):
    """The smallest node that each reaches."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
