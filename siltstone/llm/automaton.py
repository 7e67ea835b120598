"""A generalised suffix automaton of bounded depth over runs of word codes, in array form.

A state is a class of substrings that end at the same positions: the suffixes, from
``least`` to ``length`` words, of its longest one. Its suffix link leads to the state of
the next shorter suffix, which ends at more positions. Substrings of more than
``depth`` words aren't told apart by what is further ahead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Level:
    """The distinct substrings of one length: where each ends first, how often, and its suffix and prefix one word shorter, by their numbers there."""

    end: np.ndarray
    count: np.ndarray
    suffix: np.ndarray
    prefix: np.ndarray
    least: np.ndarray


class SuffixAutomaton:
    """The substrings of up to ``depth`` words of the runs in ``codes``, which negative codes part.

    ``alive`` says of the words (by code) and of the pairs (by their number in order of
    first and second code) whether substrings are to hold them.
    """

    def __init__(self, codes: np.ndarray, n_words: int, depth: int, alive: tuple[np.ndarray, np.ndarray] | None = None):
        codes = codes.astype(np.int64)
        self.codes, self.n_words = codes, n_words
        there = np.flatnonzero(codes >= 0)
        count = np.bincount(codes[there], minlength=n_words)
        end = np.full(n_words, -1, dtype=np.int64)
        end[codes[there][::-1]] = there[::-1]
        none = np.empty(0, dtype=np.int64)
        if alive is not None:
            count = np.where(alive[0], count, 0)
        self.levels = [Level(end, count, none, none, np.ones(n_words, dtype=np.int64))]
        at = codes
        for d in range(2, depth + 1):
            own = np.flatnonzero((at[1:] >= 0) & (at[:-1] >= 0)) + 1
            distinct, first, number, count = np.unique(at[own - 1] * n_words + codes[own], return_index=True, return_inverse=True, return_counts=True)
            if alive is not None and d == 2:
                left = np.flatnonzero(alive[1])
                new = np.full(len(distinct), -1, dtype=np.int64)
                new[left] = np.arange(len(left))
                first, count, number = first[left], count[left], new[number]
            before, here = at, np.full(len(codes), -1, dtype=np.int64)
            here[own] = number
            end = own[first]
            suffix = before[end]
            below = self.levels[-1]
            least = np.where(below.count[suffix] == count, below.least[suffix], d)
            self.levels.append(Level(end, count, suffix, before[end - 1], least))
            at = here

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """First and second code of the distinct pairs, in order of both."""
        pair = self.levels[1]
        return pair.prefix, pair.suffix

    def states(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, end, least, count) of the states by length of their longest substring: a class's suffixes of ``least`` to ``length`` words."""
        for d, level in enumerate(self.levels, 1):
            longest = level.count > 0
            if d < len(self.levels):
                longer = self.levels[d]
                longest[longer.suffix[longer.count == level.count[longer.suffix]]] = False
            own = np.flatnonzero(longest)
            yield d, level.end[own], level.least[own], level.count[own]

    def transition(self, length: int, number: int, code: int) -> int:
        """The number of the substring made of one of ``length`` words and a word, -1 if there is none."""
        if length == len(self.levels):
            return -1
        above = self.levels[length]
        hit = np.flatnonzero((above.prefix == number) & (self.codes[above.end] == code))
        return int(hit[0]) if len(hit) else -1
