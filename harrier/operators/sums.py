"""Sums over all pairs of a list of scores, in time that grows with the list and not with its square.

Counts of pairs come from sorting. The logistic function and its integral are smooth: over a cell of width one they are
polynomials of degree 15 to the last digits of a double (their poles are pi away from the real line), so what
a cell's scores do to others is told by their weights on the cell's sixteen Chebyshev nodes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

# fixed values: nodes of a cell, scores that are compared one by one, the largest loss of a pair
NODES, NEAR, MOST_LOSS = 16, 128, -float(np.log(1e-12))
_AT = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)
_BASIS = np.polynomial.chebyshev.chebvander(_AT, NODES - 1).T * 2 / NODES
_BASIS[0] /= 2


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def pair_loss(margin: np.ndarray) -> np.ndarray:
    """Log loss of the one ahead's margin, at most that of a probability of 1e-12."""
    return np.minimum(np.logaddexp(0.0, -margin), MOST_LOSS)


class Cells:
    """Scores on the nodes of the occupied cells of width one."""

    def __init__(self, *scores: np.ndarray):
        every = np.concatenate(scores)
        self.low = every.min() if len(every) else 0.0
        self.span = float(every.max() - self.low) if len(every) else 0.0
        self.used = np.unique(np.floor(every - self.low).astype(np.int64)) if self.span < 2**40 else np.arange(0)
        self.nodes = (self.low + self.used[:, None] + (_AT[None, :] + 1) / 2).ravel()

    def pays(self, n: int) -> bool:
        """Whether the nodes are fewer than the scores of a list."""
        return self.span < 2**40 and n > len(self.nodes) > 0

    def weights(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each score the first of its cell's nodes, and its weight on each of them."""
        cell = np.floor(scores - self.low)
        u = 2 * (scores - self.low - cell) - 1
        return np.searchsorted(self.used, cell.astype(np.int64)) * NODES, np.polynomial.chebyshev.chebvander(u, NODES - 1) @ _BASIS

    def on_nodes(self, scores: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
        """The weights of each of ``n`` groups of scores, summed."""
        first, w = self.weights(scores)
        at = (groups * len(self.nodes) + first)[:, None] + np.arange(NODES)
        return np.bincount(at.ravel(), w.ravel(), n * len(self.nodes)).reshape(n, -1)

    def kernel(self, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        return f(self.nodes[:, None] - self.nodes[None, :])


def expected_wins(scores: np.ndarray, block: int) -> np.ndarray:
    """The sum of logistic(score - other) over all scores, its own included, for each."""
    cells = Cells(scores)
    if len(scores) > block and cells.pays(len(scores)):
        zero = np.zeros(len(scores), np.int64)
        sums = cells.kernel(logistic) @ cells.on_nodes(scores, zero, 1)[0]
        first, w = cells.weights(scores)
        return (sums[first[:, None] + np.arange(NODES)] * w).sum(axis=1)
    out = np.zeros(len(scores))
    for lo in range(0, len(scores), block):
        with np.errstate(over="ignore"):
            out += logistic(scores[:, None] - scores[None, lo : lo + block]).sum(axis=1)
    return out


def higher_before(scores: np.ndarray) -> tuple[int, int]:
    """Of pairs i < j: how many have a higher score first, and how many equal scores.

    Scores are numbered; two numbers part at the highest bit in which they differ, and numbers are kept in order of their higher
    bits, within these in the list's order, so that at each bit those with it are counted up to each one without.
    """
    _, number, times = np.unique(scores, return_inverse=True, return_counts=True)
    equal = int((times * (times - 1) // 2).sum())
    ends = np.concatenate([[0], np.cumsum(times)])
    higher, m = 0, len(times)
    for bit in reversed(range(max(0, m - 1).bit_length())):
        one = (number >> bit) & 1
        lo = ends[(number >> (bit + 1)) << (bit + 1)]
        middle = ends[np.minimum(((number >> (bit + 1)) << (bit + 1)) + (1 << bit), m)]
        ones = np.cumsum(one) - one  # of all before
        before = ones - np.concatenate([[0], np.cumsum(one)])[lo]
        higher += int(before[one == 0].sum())
        at = np.where(one == 1, middle + before, np.arange(len(number)) - before)
        placed = np.empty_like(number)
        placed[at] = number
        number = placed
    return higher, equal


def higher_across(ahead: np.ndarray, behind: np.ndarray) -> tuple[int, int]:
    """The same of each of ``ahead`` with each of ``behind``."""
    behind = np.sort(behind)
    less, no_more = np.searchsorted(behind, ahead, "left"), np.searchsorted(behind, ahead, "right")
    return int(less.sum()), int((no_more - less).sum())


def losses_before(scores: np.ndarray) -> float:
    """The sum of pair_loss(score of i - score of j) over pairs i < j."""
    n, total = len(scores), 0.0
    cells = Cells(scores)
    smooth = cells.span < MOST_LOSS and n > NEAR and cells.pays(n)
    for lo in range(0, n, NEAR):
        some = scores[lo : lo + NEAR]
        total += float(np.triu(pair_loss(some[:, None] - some[None, :]), 1).sum())
        if not smooth:  # scores so far apart that losses reach their bound: pair by pair
            total += sum(float(pair_loss(some[:, None] - scores[None, k : k + 8192]).sum()) for k in range(lo + NEAR, n, 8192))
    if smooth:
        w = cells.on_nodes(scores, np.arange(n) // NEAR, -(-n // NEAR))
        earlier = np.cumsum(w, axis=0) - w
        total += float(((earlier @ cells.kernel(pair_loss)) * w).sum())
    return total


def losses_across(ahead: np.ndarray, behind: np.ndarray) -> float:
    """The same of each of ``ahead`` with each of ``behind``."""
    cells = Cells(ahead, behind)
    if cells.span < MOST_LOSS and cells.pays(min(len(ahead), len(behind))):
        a, b = (cells.on_nodes(x, np.zeros(len(x), np.int64), 1)[0] for x in (ahead, behind))
        return float(a @ cells.kernel(pair_loss) @ b)
    return sum(float(pair_loss(ahead[lo : lo + 1024, None] - behind[None, k : k + 8192]).sum()) for lo in range(0, len(ahead), 1024) for k in range(0, len(behind), 8192))
