"""Minimal acyclic transducers: sorted terms as an automaton whose transitions add up to a term's ordinal.

Terms are bytes in ascending order.  A term's path from the start to a final state gives, as
the sum of the numbers on its transitions, how many terms stand before it.  States that lead
to the same endings are one, so the automaton is the smallest there is.

As arrays: state s has cells for the bytes ``low[s]`` to ``high[s]``, the first of them at
``base[s] + low[s]``; a cell is the next state and the number, 32 bits each.  State 0 and cell 0
lead nowhere.  Texts run through it a byte of all words at a time.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np


class Transducer(NamedTuple):
    low: np.ndarray
    high: np.ndarray
    base: np.ndarray
    final: np.ndarray
    cells: np.ndarray
    start: int

    @property
    def size(self) -> int:
        return sum(a.nbytes for a in self[:5])


def build(terms: Iterable[bytes]) -> Transducer:
    """The minimal transducer of ``terms``, which ascend and differ.

    A state is settled as soon as no further term can pass it: equal ones (same
    transitions, same finality) have one number.
    """
    numbers: dict[tuple, int] = {}
    counts, settled = [0], []  # of each state: its terms; final, labels, next states
    path: list[list] = [[False, [], []]]
    before = b""

    def settle(node: list) -> int:
        key = (node[0], bytes(node[1]), tuple(node[2]))
        if (found := numbers.get(key)) is None:
            found = numbers[key] = len(numbers) + 1
            settled.append(key)
            counts.append(node[0] + sum(counts[s] for s in node[2]))
        return found

    def fold(depth: int) -> None:
        while len(path) > depth + 1:
            number = settle(path.pop())
            path[-1][2].append(number)

    for term in terms:
        same = 0
        for a, b in zip(before, term, strict=False):
            if a != b:
                break
            same += 1
        fold(same)
        for byte in term[same:]:
            path[-1][1].append(byte)
            path.append([False, [], []])
        path[-1][0] = True
        before = term
    fold(0)
    start = settle(path[0])

    n = len(settled) + 1
    low, high = np.ones(n, np.uint8), np.zeros(n, np.uint8)
    base, final = np.zeros(n, np.int64), np.zeros(n, bool)
    at, places, values = 1, [], []
    for s, (is_final, labels, following) in enumerate(settled, 1):
        final[s] = is_final
        if labels:
            low[s], high[s], base[s] = labels[0], labels[-1], at - labels[0]
            skipped = int(is_final)
            for byte, to in zip(labels, following, strict=True):
                places.append(at - labels[0] + byte)
                values.append(to << 32 | skipped)
                skipped += counts[to]
            at += labels[-1] - labels[0] + 1
    cells = np.zeros(at, np.int64)
    cells[places] = values
    return Transducer(low, high, base, final, cells, start)


def together(parts: list[Transducer]) -> tuple[Transducer, list[int]]:
    """All transducers in one set of arrays, and the start state of each."""
    states = np.cumsum([0, *(len(t.final) for t in parts)])
    cells = np.cumsum([0, *(len(t.cells) for t in parts)])
    moved = [np.where(t.cells > 0, t.cells + (np.int64(s) << 32), 0) for t, s in zip(parts, states, strict=False)]
    empty = [np.zeros(1, np.int64)]
    return Transducer(
        np.concatenate([t.low for t in parts] or [np.ones(1, np.uint8)]), np.concatenate([t.high for t in parts] or [np.zeros(1, np.uint8)]),
        np.concatenate([t.base + c for t, c in zip(parts, cells, strict=False)] or empty), np.concatenate([t.final for t in parts] or [np.zeros(1, bool)]),
        np.concatenate(moved or empty), 0), [t.start + int(s) for t, s in zip(parts, states, strict=False)]


def ordinals(t: Transducer, start: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The ordinal of each word ``data[starts:ends]`` (none is empty), -1 if it is no term; ``start``: each word's start state."""
    lengths = ends - starts
    kind = np.int16 if len(lengths) and lengths.max() < 1 << 15 else np.int64
    order = np.argsort(-lengths.astype(kind), kind="stable")  # long words first, so that those going on stand in front
    at, state = starts[order], start[order].astype(np.int64)
    total = np.zeros(len(order), np.int64)
    longer = np.cumsum(np.bincount(lengths)[::-1])[::-1] if len(lengths) else np.zeros(0, np.int64)
    for k in range(len(longer) - 1):
        m = int(longer[k + 1])
        s, byte = state[:m], data[at[:m] + k]
        place = np.where((byte >= t.low[s]) & (byte <= t.high[s]), t.base[s] + byte, 0)
        cell = t.cells[place]
        state[:m] = cell >> 32
        total[:m] += cell & 0xFFFFFFFF
        if k & 15 == 15 and not state[:m].any():
            state[:m] = 0
            break
    found = np.empty(len(order), np.int64)
    found[order] = np.where(t.final[state], total, -1)
    return found
