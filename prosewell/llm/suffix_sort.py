"""Sorted runs of strings with common prefixes: front coding and the loser tree that merges them.

In a run each string comes with the length it shares with the one before.  The tree keeps, for each waiting string, what it shares
with the last string that beat it; of two strings the one that shares more with the last output is the smaller, and only on a tie
are characters read, from the shared length on, so no known prefix is compared again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def front_code(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared lengths and the joined remainders of sorted distinct rows (n x width bytes)."""
    n, width = rows.shape
    shared = np.zeros(n, np.uint8)
    if n > 1:
        shared[1:] = (rows[1:] != rows[:-1]).argmax(1)
    return shared, rows[np.arange(width)[None, :] >= shared[:, None]]


def decode(shared: np.ndarray, rest: bytes, width: int) -> Iterator[tuple[int, bytes]]:
    """(shared length, string) of a front-coded run."""
    last, at = b"", 0
    for same in shared.tolist():
        take = width - same
        last = last[:same] + rest[at : at + take]
        at += take
        yield same, last


def common(a: bytes, b: bytes, width: int) -> int:
    """Length that two strings of one width share."""
    differing = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return width - (differing.bit_length() + 7 >> 3)


def merge(runs: list[Iterator[tuple[int, bytes]]], width: int) -> Iterator[tuple[int, int, bytes]]:
    """(length shared with the string before, run, string) in order; equal strings of several runs follow each other."""
    n = len(runs)
    if not n:
        return
    heads: list[bytes | None] = []
    for run in runs:
        heads.append(next(run, (0, None))[1])
    loser, shares = [0] * n, [0] * n  # of inner nodes 1 to n - 1; leaf r is node n + r

    def build(node: int) -> tuple[int, int]:
        """The winner below a node and what it shares with nothing yet."""
        if node >= n:
            return node - n, 0
        (a, _), (b, _) = build(2 * node), build(2 * node + 1)
        if heads[b] is None or (heads[a] is not None and heads[a] <= heads[b]):
            win, lose = a, b
        else:
            win, lose = b, a
        loser[node] = lose
        shares[node] = -1 if heads[lose] is None else common(heads[win], heads[lose], width)
        return win, 0

    winner, share = build(1) if n > 1 else (0, 0)
    while heads[winner] is not None:
        yield share, winner, heads[winner]
        same, text = next(runs[winner], (-1, None))
        heads[winner] = text
        node = n + winner >> 1
        while node:
            other = shares[node]
            if same < other:
                winner, loser[node] = loser[node], winner
                same, shares[node] = other, same
            elif same == other >= 0:
                rival = loser[node]
                x, y = heads[winner], heads[rival]
                if x[same:] > y[same:]:
                    loser[node], winner = winner, rival
                shares[node] = common(x, y, width)
            node >>= 1
        share = same
