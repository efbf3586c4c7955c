"""Sums over a quadrant of price and time, and where along time they reach a target, without pairs.

``Dominance`` holds events as a wavelet matrix: in order of price, the bits of their places
in time level by level, with running weights.  A sum over the k cheapest events before time
place t, and the first time place at which a sum over the k cheapest exceeds a target, each
take one step per bit, for all queries at once.
"""

from __future__ import annotations

import numpy as np


class Dominance:
    """Events at prices, in order of time, with weights."""

    def __init__(self, prices: np.ndarray, weights: np.ndarray) -> None:
        self.n = len(prices)
        by_price = np.argsort(prices, kind="stable")
        self.prices = np.asarray(prices)[by_price]
        self.bits = max(1, int(self.n - 1).bit_length()) if self.n else 1
        self.levels: list[tuple[np.ndarray, int, np.ndarray]] = []  # zeros before each place, zeros in all, running weight of the zeros
        places, weights = by_price.astype(np.int64), np.asarray(weights, np.float64)[by_price]
        for bit in range(self.bits - 1, -1, -1):
            zero = (places >> bit & 1) == 0
            zeros = np.concatenate([[0], np.cumsum(zero)])
            self.levels.append((zeros, int(zeros[-1]), np.concatenate([[0.0], np.cumsum(np.where(zero, weights, 0.0))])))
            order = np.argsort(~zero, kind="stable")
            places, weights = places[order], weights[order]
        self.last = np.concatenate([[0.0], np.cumsum(weights)])

    def cheapest(self, limits: np.ndarray) -> np.ndarray:
        """How many events have a price at or below each limit."""
        return np.searchsorted(self.prices, limits, side="right")

    def before(self, k: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The weight of those of the k cheapest events that come before time place t."""
        low, high, total = np.zeros(len(k), np.int64), np.asarray(k, np.int64).copy(), np.zeros(len(k))
        whole = t >= 1 << self.bits
        for level, (zeros, all_zeros, weight) in enumerate(self.levels):
            one = (t >> (self.bits - 1 - level) & 1).astype(bool) | whole
            total += np.where(one, weight[high] - weight[low], 0.0)
            low = np.where(one, all_zeros + low - zeros[low], zeros[low])
            high = np.where(one, all_zeros + high - zeros[high], zeros[high])
        return total + np.where(whole, self.last[high] - self.last[low], 0.0)

    def reach(self, k: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first time place up to which the k cheapest events weigh more than the target; n where they never do."""
        low, high, left = np.zeros(len(k), np.int64), np.asarray(k, np.int64).copy(), np.asarray(target, np.float64).copy()
        place = np.zeros(len(k), np.int64)
        for level, (zeros, all_zeros, weight) in enumerate(self.levels):
            own = weight[high] - weight[low]
            right = own <= left
            left = np.where(right, left - own, left)
            place = place << 1 | right
            low = np.where(right, all_zeros + low - zeros[low], zeros[low])
            high = np.where(right, all_zeros + high - zeros[high], zeros[high])
        return np.where(self.last[high] - self.last[low] > left, place, self.n)


def consumed(prices: np.ndarray, weights: np.ndarray, limits: np.ndarray, first: np.ndarray, last: np.ndarray, queue: np.ndarray, quantity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which query takes how much at which event: (query, event, amount), in order of query and time.

    Events are in order of time, with weights above 0.  A query takes from the events of
    places first to last - 1 at or below its limit, the queue's share passed over, until its
    quantity is used up.  Only what is taken is looked at: each round moves all open queries
    to their next event.
    """
    events = Dominance(prices, weights)
    k = events.cheapest(limits)
    start = events.before(k, first)
    open_ = np.flatnonzero((quantity > 0) & (first < last) & (k > 0))
    seen = start + np.maximum(queue, 0.0)  # what weighs before the next taking
    queries, places, amounts = [], [], []
    while len(open_):
        at = events.reach(k[open_], seen[open_])
        inside = at < last[open_]
        open_, at = open_[inside], at[inside]
        if not len(open_):
            break
        upto = events.before(k[open_], at + 1)
        end = start[open_] + np.maximum(queue[open_], 0.0) + quantity[open_]
        amount = np.minimum(upto, end) - seen[open_]
        queries.append(open_)
        places.append(at)
        amounts.append(amount)
        seen[open_] = upto
        open_ = open_[upto < end]
    if not queries:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    query, place, amount = map(np.concatenate, (queries, places, amounts))
    order = np.lexsort([place, query])
    return query[order], place[order], amount[order]
