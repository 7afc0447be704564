"""Byte-pair merging of one piece, shared by the encoder and the counter."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterable


def merge_piece(piece: bytes, rank_of: Callable[[bytes, bytes], int | None]) -> list[bytes]:
    """Join the adjacent pair of lowest rank, leftmost first, until no pair has a rank.

    Pairs wait in a heap and parts form a linked list, so a piece of n bytes takes n log n steps.
    """
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    if n < 2:
        return parts
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := rank_of(parts[i], parts[j])) is not None:
            heapq.heappush(heap, (rank, i, parts[i], parts[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else n
        if j >= n or parts[i] != left or parts[j] != right:
            continue  # one of the two has been joined meanwhile
        parts[i], parts[j] = left + right, None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [p for p in parts if p is not None]


def rank_table(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and a number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Memo(dict):
    """Results by piece in two generations: when the young one is full it becomes the old one and the old one goes.

    Frequent pieces stay, a worker's memory is bounded, and a forgotten piece is only worked out again.
    """

    def __init__(self, make: Callable, most: int = 100_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, piece):
        if (made := self.old.get(piece)) is None:
            made = self.make(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = made
        return made
