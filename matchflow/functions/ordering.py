"""Arrival order against sequence numbers, on arrays.

The state of a shard is the last number given out and the numbers that wait.
A number waits while fewer than ``gap`` numbers before it are missing, for
``lateness`` at most. So the last number lies at most ``gap + 1`` below the
highest one seen, and which numbers wait follows from it and from the arrivals
of the last moments. An arrival is thus a map from ``gap + 2`` possible places
of the last number to themselves; maps compose, whatever came before.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

LATE, TOO_LATE, IN_ORDER, GAP_SKIPPED, RELEASED, OVERTAKEN, EXPIRED, WAITING = range(8)
#: Action and outcome by code.
NAMES = [
    ("reprocess", "late"), ("drop", "too_late"), ("process", "in_order"), ("process", "gap_skipped"),
    ("buffer", "released"), ("buffer", "overtaken"), ("buffer", "expired"), ("buffer", "waiting"),
]


class Rules(NamedTuple):
    gap: int
    lateness: int


class Held(NamedTuple):
    """Numbers that arrived before and may wait, by the time since when."""

    seq: np.ndarray
    since: np.ndarray


NOTHING = Held(np.zeros(0, "i8"), np.zeros(0, "i8"))


def chain_ends(seq: np.ndarray, clock: np.ndarray, held: Held, rules: Rules) -> np.ndarray:
    """Last of the numbers that follow each arrival without a break and have come, not too long ago."""
    every, since = np.concatenate([held.seq, seq]), np.concatenate([held.since, clock])
    numbers, place = np.unique(every, return_inverse=True)
    total = len(every)
    order = np.argsort(place * total + np.arange(total), kind="stable")
    arrived = (place * total + np.arange(total))[order]  # by number, then arrival
    ends, alive = seq.copy(), np.arange(len(seq))
    for step in range(1, rules.gap + 1):
        wanted = seq[alive] + step
        at = np.minimum(np.searchsorted(numbers, wanted), len(numbers) - 1)
        found = np.searchsorted(arrived, at * total + len(held.seq) + alive) - 1
        last = order[np.maximum(found, 0)]
        fits = (found >= 0) & (every[last] == wanted) & (clock[alive] - since[last] <= rules.lateness)
        alive = alive[fits]
        if not len(alive):
            break
        ends[alive] = seq[alive] + step
    return ends


def transitions(seq: np.ndarray, clock: np.ndarray, top: int, held: Held, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """The map of every arrival, and the highest number after it.

    A place is the distance of the last number from the highest one.
    """
    after = np.maximum.accumulate(np.concatenate([[top], seq]))
    before, after = after[:-1], after[1:]
    last = before[:, None] - np.arange(rules.gap + 2)
    skipped = seq[:, None] - last - 1
    ends = chain_ends(seq, clock, held, rules)
    moved = np.where(skipped == 0, ends[:, None], np.where(skipped > rules.gap, seq[:, None], last))
    return np.clip(after[:, None] - moved, 0, rules.gap + 1), after


def composed(maps: np.ndarray) -> np.ndarray:
    """Row i: the maps 0 to i, one after the other."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], axis=1)
        step *= 2
    return out


class Settled(NamedTuple):
    own: np.ndarray  # code of every arrival, WAITING where it had to wait and still does
    held: np.ndarray  # code of what was held before
    last: int
    top: int


def settle(
    seq: np.ndarray, clock: np.ndarray, age: np.ndarray, top: int | None, last: int | None, held: Held, rules: Rules
) -> Settled:
    """What becomes of arrivals in their order, and of the numbers that wait.

    ``clock`` must not fall. ``held`` are numbers above ``last`` that wait.
    """
    if last is None:
        top = last = int(seq[0]) - 1
    if top == last and not len(held.seq) and (seq == last + 1 + np.arange(len(seq))).all():
        return Settled(np.full(len(seq), IN_ORDER), np.zeros(0, "i8"), int(seq[-1]), int(seq[-1]))
    maps, after = transitions(seq, clock, top, held, rules)
    last_after = after - composed(maps)[:, top - last]
    skipped = seq - np.concatenate([[last], last_after[:-1]]) - 1
    own = np.select(
        [skipped < 0, skipped == 0, skipped > rules.gap],
        [np.where(age <= rules.lateness, LATE, TOO_LATE), IN_ORDER, GAP_SKIPPED], WAITING,
    )
    waits = np.flatnonzero(own == WAITING)
    number = np.concatenate([held.seq, seq[waits]])
    since = np.concatenate([held.since, clock[waits]])
    gone = np.searchsorted(clock, since + rules.lateness, side="right")  # the clock has passed its time
    met = np.searchsorted(last_after, number, side="left")  # the last number has reached it
    at = np.minimum(met, len(seq) - 1)
    fate = np.select(
        [(gone <= met) & (gone < len(seq)), (met < len(seq)) & (seq[at] < number), met < len(seq)],
        [EXPIRED, RELEASED, OVERTAKEN], WAITING,
    )
    own[waits] = fate[len(held.seq):]
    return Settled(own, fate[:len(held.seq)], int(last_after[-1]), int(after[-1]))
