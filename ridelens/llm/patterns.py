"""How often each pattern of lengths fills a sequence: a plan made from a histogram of lengths alone."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np

SWEEPS = 3
SHARES = (1.0, 0.9, 0.75, 0.5, 0.0)  # of the fitted counts that are tried
Plan = list[tuple[tuple[int, ...], int]]  # lengths of a sequence, longest first, and how many such sequences


def exact_patterns(lengths: Iterable[int], room: int) -> list[tuple[int, ...]]:
    """Patterns of few documents that fill a sequence without a gap, from the given lengths.

    Two lengths, three lengths, and one length repeated with at most one other. Their
    number depends on `room` only: some 90,000 at 1024.
    """
    have = np.zeros(room + 1, bool)
    have[[n for n in set(lengths) if 0 < n <= room]] = True
    found = {(room,)} if have[room] else set()
    present = np.flatnonzero(have[:room]).tolist()
    for a in present:
        for times in range(1, room // a + 1):
            rest = room - times * a
            if rest == 0 or have[rest]:
                found.add(tuple(sorted((a,) * times + (rest,) * (rest > 0), reverse=True)))
        middle = np.arange((room - a + 1) // 2, min(a, room - a - 1) + 1)
        for b in middle[have[middle] & have[room - a - middle]].tolist():
            found.add((a, b, room - a - b))
    return sorted(found, key=lambda p: (len(p) > 2, [-n for n in p]))


def fit(counts: np.ndarray, patterns: list[tuple[int, ...]]) -> np.ndarray:
    """Repeat counts >= 0 of the patterns whose lengths come near to the histogram in the sense of least squares.

    Coordinate descent: each step sets one count to its best value given the others,
    pairs first and long lengths first, as those are hard to place later. A few sweeps
    keep most counts zero, so that little is lost when they are rounded.
    """
    parts = [(tuple(Counter(p).items()), float(sum(m * m for m in Counter(p).values()))) for p in patterns]
    times = [0.0] * len(parts)
    left = counts.astype(float).tolist()
    for _ in range(SWEEPS):
        for j, (lengths, norm) in enumerate(parts):
            slope = 0.0
            for n, m in lengths:
                slope += m * left[n]
            had = times[j]
            step = max(slope / norm, -had)
            if step:
                times[j] = had + step
                for n, m in lengths:
                    left[n] -= m * step
    return np.array(times)


def _rounded(patterns: list[tuple[int, ...]], times: np.ndarray, left: np.ndarray) -> Plan:
    """Counts rounded down; no length is used more often than it is there."""
    made = []
    for j in np.argsort(-times, kind="stable").tolist():
        if times[j] < 1:
            break
        n_times = min([int(times[j]), *(int(left[n]) // m for n, m in Counter(patterns[j]).items())])
        if n_times:
            for n in patterns[j]:
                left[n] -= n_times
            made.append((patterns[j], n_times))
    return made


def _best_fit(left: np.ndarray, room: int) -> Plan:
    """The rest: the longest first, each gap filled exactly by one or two lengths if that can be, else by the longest that fits.

    A pattern is repeated as often as its lengths last, so each one uses up a length.
    """
    plan = []
    while left.any():
        taken: Counter[int] = Counter()
        gap = room
        while gap:
            free = left[: gap + 1].copy()
            for n, m in taken.items():
                if n <= gap:
                    free[n] -= m
            fits = np.flatnonzero(free[1:]) + 1
            if not len(fits):
                break
            n = int(fits[-1])
            if taken and n != gap:
                others = gap - fits
                pairs = fits[(free[others] > (others == fits)) & (others > 0)]
                n = int(pairs[-1]) if len(pairs) else n
            taken[n] += 1
            gap -= n
        made = min(int(left[n]) // m for n, m in taken.items())
        for n, m in taken.items():
            left[n] -= m * made
        plan.append((tuple(sorted(taken.elements(), reverse=True)), made))
    return plan


def plan(counts: np.ndarray, room: int) -> Plan:
    """Sequences for all lengths of a histogram (counts[n] pieces of length n): fitted patterns, then best fit of the rest.

    The more is left to best fit, the better long and short lengths find each other, so
    several shares of the fit are rounded, and the one that needs fewest sequences is
    taken. All work depends on `room` and not on the number of pieces.
    """
    there = counts.astype(np.int64).copy()
    whole = int(there[room])
    there[room] = 0
    patterns = exact_patterns(np.flatnonzero(there).tolist(), room)
    times = fit(there, patterns)
    tried = []
    for share in SHARES:
        left = there.copy()
        tried.append(_rounded(patterns, share * times, left) + _best_fit(left, room))
    best = min(tried, key=lambda made: sum(n for _, n in made))
    return [((room,), whole)] * bool(whole) + best


class Slots:
    """Where the k-th piece of a length goes: its sequence and its place there."""

    BITS = 50  # of a rank; lengths stand above them

    def __init__(self, made: Plan):
        rows, used, sequence = [], Counter(), 0
        for pattern, times in made:
            at = 0
            for n, m in sorted(Counter(pattern).items(), reverse=True):
                rows.append((n << self.BITS | used[n], sequence, m, at))
                used[n] += m * times
                at += n * m
            sequence += times
        self.n_sequences = sequence
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.first, self.sequence, self.repeats, self.at = (np.ascontiguousarray(c) for c in table.T)

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length.astype(np.int64) << self.BITS | rank
        row = np.searchsorted(self.first, key, "right") - 1
        turn, within = np.divmod(key - self.first[row], self.repeats[row])
        return self.sequence[row] + turn, self.at[row] + within * length
