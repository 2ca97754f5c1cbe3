"""Overlapping line windows that prefer to end on a blank line."""

from __future__ import annotations

from collections.abc import Iterator

WINDOW, OVERLAP = 60, 10


def line_windows(blank: list[bool], size: int = WINDOW, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """(begin, stop) of each window over lines of which ``blank`` tells the blank ones.

    A window that isn't the last ends after the last blank line of its second half, if there is one.
    """
    begin, n = 0, len(blank)
    while begin < n:
        stop = min(begin + size, n)
        if stop < n:
            half = max(begin + size // 2, begin + 1)
            stop = max((j for j in range(half + 1, stop + 1) if blank[j - 1]), default=stop)
        yield begin, stop
        if stop == n:
            return
        begin = max(stop - overlap, begin + 1)
