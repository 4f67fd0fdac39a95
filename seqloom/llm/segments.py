"""All maximal-scoring segments of a sequence of scores, in linear time."""

from __future__ import annotations

from collections.abc import Sequence


def maximal_segments(scores: Sequence[float], least: float = 0.0) -> list[tuple[int, int, float]]:
    """``(start, end, sum)`` of every maximal-scoring segment with a sum over ``least``, ``end`` exclusive, in order.

    No segment can be extended or shortened to a higher sum, and they are disjoint. Each candidate looks back along a chain of
    candidates with smaller left sums, so the whole takes time in proportion to the length.
    """
    starts: list[int] = []
    ends: list[int] = []
    left: list[float] = []  # sum before the candidate
    right: list[float] = []  # sum up to its end
    back: list[int] = []  # nearest earlier candidate with a smaller left sum, or -1
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        a, lo, hi = i, before, total
        j = len(starts) - 1
        while True:
            while j >= 0 and left[j] >= lo:
                j = back[j]
            if j < 0 or right[j] >= hi:
                break
            a, lo = starts[j], left[j]  # joins candidate j; all after it are swallowed
            del starts[j:], ends[j:], left[j:], right[j:], back[j:]
            j = len(starts) - 1
        starts.append(a)
        ends.append(i + 1)
        left.append(lo)
        right.append(hi)
        back.append(j)
    return [(a, b, r - p) for a, b, p, r in zip(starts, ends, left, right) if r - p > least]
