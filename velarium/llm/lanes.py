"""Many sequences of very different lengths side by side, so that one numpy step serves a full row of them."""

from __future__ import annotations

import heapq

import numpy as np


def lanes_of(texts: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Lay symbol sequences in lanes, longest first to the shortest lane: symbols and text numbers, -1 where a lane is over."""
    heap, rows = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for d in sorted(range(len(texts)), key=lambda d: (-len(texts[d]), d)):
        n, k = heapq.heappop(heap)
        rows[k].append(d)
        heapq.heappush(heap, (n + len(texts[d]), k))
    steps = max((n for n, _ in heap), default=0)
    symbols, owner = np.zeros((steps, lanes), np.int32), np.full((steps, lanes), -1, np.int32)
    for k, docs in enumerate(rows):
        at = 0
        for d in docs:
            symbols[at : at + len(texts[d]), k], owner[at : at + len(texts[d]), k] = texts[d], d
            at += len(texts[d])
    return symbols, owner
