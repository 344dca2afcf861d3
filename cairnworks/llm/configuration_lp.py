"""The configuration linear program of packing, and its rounding.

Columns are patterns, multisets of lengths that fit a sequence and that demand can fill; the
program asks for the fewest patterns that cover the demand of every length. Multiplicative weights
keep a price for each length, and a knapsack dynamic program over the demand gives the best-paid
filling of every room, in layers of lengths.

The first round, at equal prices, answers in whole numbers (``respond``): a sweep over the layers
from the longest length down hands each length out to the open sequences whose best filling holds
it, and pieces that none wants open sequences. Prices over the best-paid pattern's pay are a feasible
dual solution, whose value bounds every cover from below; where cover and bound agree, the program
is solved. Otherwise more rounds follow (``solve``): each length behind the schedule gets the
best-paid pattern that holds it, equal ones by chance; lengths covered ahead of the schedule get
cheaper, the others dearer. The last round covers all demand, so the amounts are feasible too.

Rounding takes full patterns as often as the floor of their amounts says, then once each, the
most used first, as long as demand is left for all they hold; the program of what is left is
answered in whole numbers, or solved and rounded again. The plan is the deepest of these with the
fewest sequences. Every sequence of it holds a pattern that the dynamic program priced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np

#: Rounds of the first program and of those for what is left, and how often that is solved again.
ROUNDS = 16
LATER_ROUNDS = 4
DEPTH = 12
#: How strongly prices answer to coverage.
ETA = 2.0
#: Pays that differ by less are equal; the chance that an item that makes no difference is taken.
TIE = 1e-7
TAKE_TIES = 0.3
#: Share of what is left that a rounding has to place to be followed by another.
LEAST_SHARE = 0.03

Plan = list[tuple[int, dict[int, int]]]


@dataclass
class Solution:
    """Patterns {index of length: copies}, how often each is used, and the best dual bound."""

    patterns: list[dict[int, int]]
    amounts: np.ndarray
    bound: float

    @property
    def value(self) -> float:
        return float(self.amounts.sum())


def _items(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of length, copies) of the 0/1 items that make up every useful number of copies."""
    index, copies = [], []
    for i, (length, n) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        n, k = min(int(n), capacity // length), 1
        while n > 0:
            k = min(k, n)
            index.append(i)
            copies.append(k)
            n, k = n - k, 2 * k
    return np.array(index), np.array(copies)


def knapsack(sizes: np.ndarray, pays: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(best pay within each room 0..capacity, item k's part in it there after items 0..k).

    The part is 2 where the item has to be taken for the best pay, 1 where it makes no difference.
    """
    best = np.zeros(capacity + 1)
    part = np.zeros((len(sizes), capacity + 1), np.uint8)
    for k, (size, pay) in enumerate(zip(sizes.tolist(), pays.tolist(), strict=True)):
        offer = best[: capacity + 1 - size] + pay
        held = best[size:]
        gain = offer - held
        np.add(gain > TIE, gain > -TIE, out=part[k, size:], dtype=np.uint8, casting="unsafe")
        np.maximum(offer, held, out=held)
    return best, part


class _Sweep:
    """Open sequences, as groups of equal ones: room left, how many, and what they hold (linked lists)."""

    def __init__(self, size: int):
        self.room, self.times, self.n = np.zeros(size, np.int64), np.zeros(size, np.int64), 0
        self.held: list[tuple | None] = []

    def open(self, room: int, times: int, held: tuple | None) -> None:
        if self.n == len(self.room):
            self.room, self.times = (np.concatenate([a, np.zeros_like(a)]) for a in (self.room, self.times))
        self.room[self.n], self.times[self.n] = room, times
        self.held.append(held)
        self.n += 1

    def hand_out(self, item: tuple[int, int], size: int, at: np.ndarray, most: int) -> int:
        """Gives one item to each sequence of the groups ``at``, in that order, ``most`` times in all; how many it gave."""
        after = np.cumsum(self.times[at])
        whole = int(np.searchsorted(after, most, side="right"))
        given = int(after[whole - 1]) if whole else 0
        for g in at[:whole].tolist():
            self.held[g] = (self.held[g], item)
        self.room[at[:whole]] -= size
        if whole < len(at) and given < most:
            g = int(at[whole])
            self.open(int(self.room[g]) - size, most - given, (self.held[g], item))
            self.times[g] -= most - given
            given = most
        return given


def respond(left: dict[int, int], capacity: int) -> tuple[Plan, float]:
    """(runs (number of sequences, {length: copies}) that hold exactly the pieces of ``left``, dual bound), at equal prices."""
    if not left:
        return [], 0.0
    lengths = np.array(sorted(left))
    counts = np.array([left[x] for x in lengths.tolist()])
    index, copies = _items(lengths, counts, capacity)
    sizes = lengths[index] * copies
    best, part = knapsack(sizes, sizes.astype(float), capacity)
    state = _Sweep(4 * len(lengths) + 64)
    k = len(index) - 1
    for i in range(len(lengths) - 1, -1, -1):
        rest, length, last = int(counts[i]), int(lengths[i]), k
        while k >= 0 and index[k] == i:
            c = int(copies[k])
            at = np.flatnonzero(part[k][state.room[: state.n]])
            if rest >= c and len(at):
                at = at[np.argsort(state.room[at], kind="stable")]
                rest -= c * state.hand_out((length, c), c * length, at, rest // c)
            k -= 1
        if rest:
            own, room = 1, capacity - length
            for j in range(last, k, -1):  # copies that a sequence of this length wants besides
                if part[j][room]:
                    own, room = own + int(copies[j]), room - int(copies[j]) * length
            if rest // own:
                state.open(capacity - own * length, rest // own, (None, (length, own)))
            if rest % own:
                state.open(capacity - rest % own * length, 1, (None, (length, rest % own)))
    plan: Plan = []
    for g in range(state.n):
        if state.times[g]:
            pattern: Counter[int] = Counter()
            held = state.held[g]
            while held:
                held, (length, c) = held
                pattern[length] += c
            plan.append((int(state.times[g]), dict(pattern)))
    return plan, float(counts @ lengths) / best[capacity]


def _best_patterns(heads: np.ndarray, lengths: np.ndarray, index: np.ndarray, copies: np.ndarray, part: np.ndarray, capacity: int, chance: np.random.Generator) -> list[dict[int, int]]:
    """For each head the pattern {index of length: copies} of it and a best filling of the room beside it."""
    room = capacity - lengths[heads]
    sizes = lengths[index] * copies
    held: list[dict[int, int]] = [{h: 1} for h in heads.tolist()]
    for k in range(len(index) - 1, -1, -1):
        here = part[k][room]
        at = np.flatnonzero(here)
        if len(at):
            at = at[(here[at] == 2) | (chance.random(len(at)) < TAKE_TIES)]
            room[at] -= sizes[k]
            i, c = int(index[k]), int(copies[k])
            for row in at.tolist():
                held[row][i] = held[row].get(i, 0) + c
    return held


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS, seed: int = 7) -> Solution:
    """A cover of all demand by patterns, near the least number, and a lower bound of that number."""
    chance = np.random.default_rng(seed)
    index, copies = _items(lengths, counts, capacity)
    sizes = lengths[index] * copies
    covered, weights = np.zeros(len(lengths)), np.ones(len(lengths))
    used: Counter[tuple[tuple[int, int], ...]] = Counter()
    bound = 0.0
    for t in range(1, rounds + 1):
        prices = lengths * weights
        best, part = knapsack(sizes, prices[index] * copies, capacity)
        bound = max(bound, float(counts @ prices) / best[capacity])
        goal = counts * (t / rounds)
        heads = np.flatnonzero(covered < goal * (1 - 1e-12))[::-1]
        now = covered.tolist()
        for head, pattern in zip(heads.tolist(), _best_patterns(heads, lengths, index, copies, part, capacity, chance), strict=True):
            if (missing := goal[head] - now[head]) > 0:
                if pattern[head] > counts[head]:  # the head itself is one of the demanded
                    pattern[head] -= 1
                amount = missing / pattern[head]
                used[tuple(sorted(pattern.items()))] += amount
                for i, n in pattern.items():
                    now[i] += amount * n
        covered = np.array(now)
        weights *= np.exp(-ETA * np.clip(covered / counts - t / rounds, -1, 1))
        weights /= weights.max()
    patterns, amounts = [dict(p) for p in used], np.array(list(used.values()))
    over = covered - counts
    for k in np.argsort(amounts).tolist():  # what covers more than the demand goes
        spare = min(amounts[k], *(over[i] / n for i, n in patterns[k].items()))
        if spare > 0:
            amounts[k] -= spare
            for i, n in patterns[k].items():
                over[i] -= spare * n
    return Solution(patterns, amounts, bound)


def _round(found: Solution, lengths: list[int], left: dict[int, int], capacity: int) -> Plan:
    """Full patterns of a solution in whole numbers, taken out of ``left``."""
    plan: Plan = []
    for k in np.lexsort(([sum(p.values()) for p in found.patterns], -found.amounts)).tolist():
        pattern = {lengths[i]: n for i, n in found.patterns[k].items()}
        if found.amounts[k] > 0 and sum(x * n for x, n in pattern.items()) == capacity:
            times = min(int(max(1, found.amounts[k] + 1e-9)), *(left.get(x, 0) // n for x, n in pattern.items()))
            if times > 0:
                plan.append((times, pattern))
                for x, n in pattern.items():
                    left[x] -= times * n
                    if not left[x]:
                        del left[x]
    return plan


def sequences(plan: Plan) -> int:
    return sum(times for times, _ in plan)


def pack_lengths(histogram: dict[int, int], capacity: int, report: dict | None = None) -> Plan:
    """Runs (number of sequences, {length: copies in each}) that hold exactly the histogram's pieces.

    ``report`` receives, for lengths below the capacity, the value of the program's best cover and
    its dual bound, and the sequences that are rounded fractions and whole-number answers.
    """
    full: Plan = []
    left = {int(k): int(n) for k, n in histogram.items() if n > 0}
    if n := left.pop(capacity, 0):
        full.append((n, {capacity: 1}))
    best, bound = respond(left, capacity)
    value, best_rounded, rounded = float(sequences(best)), 0, []
    for depth in range(DEPTH):
        if sequences(best) < bound + 1 - 1e-6 or not left:
            break
        lengths = np.array(sorted(left))
        counts = np.array([left[x] for x in lengths.tolist()], float)
        found = solve(lengths, counts, capacity, LATER_ROUNDS if depth else ROUNDS, seed=depth)
        if not depth:
            bound, value = max(bound, found.bound), min(value, found.value)
        fresh = _round(found, lengths.tolist(), left, capacity)
        rounded = rounded + fresh
        plan = rounded + respond(left, capacity)[0]
        if sequences(plan) <= sequences(best):
            best, best_rounded = plan, sequences(rounded)
        if sequences(fresh) * capacity < LEAST_SHARE * float(counts @ lengths):
            break
    if report is not None:
        report.update(value=value, bound=bound, rounded=best_rounded, answered=sequences(best) - best_rounded)
    return full + best
