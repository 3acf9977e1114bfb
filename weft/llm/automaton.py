"""Generalised suffix automaton of word sequences, and matching statistics of texts against it.

The automaton holds every run of neighbouring words of its phrases.  Streaming
a text through it keeps, for each word, the length of the longest run that ends
there and is in some phrase, and the state of that run.

Whole texts are matched.  Which places can matter is found with numpy first: a
run of two words or more can only be matched where every neighbouring pair of
words is a pair of some phrase, so the automaton is stepped through those
stretches alone; between them its state is the root again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from weft.llm import text as tx


class Automaton:
    """Built from phrases, each a sequence of word hashes; a phrase without words adds nothing."""

    def __init__(self, phrases: list[np.ndarray]):
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, dtype=tx.U64), *phrases]))
        self.phrases = [np.searchsorted(self.vocabulary, p) for p in phrases]
        self.length, self.link, self.to = [0], [-1], [{}]
        #: A place (phrase, index of its last word) at which each state's runs end; -1 for the root.
        self.place: list[tuple[int, int]] = [(-1, -1)]
        ends = []
        for k, words in enumerate(self.phrases):
            last = 0
            for i, w in enumerate(words.tolist()):
                last = self._add(last, w, (k, i))
            ends.append(last)
        #: For each state, the phrases that end with its whole run.
        self.finished: list[list[int]] = [[] for _ in self.length]
        for k, state in enumerate(ends):
            if state:
                self.finished[state].append(k)
        self.by_length = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        self.suffixes = [[] for _ in self.length]
        """For each state, every phrase that is a suffix of its run, shortest first."""
        for v in self.by_length:
            up = self.suffixes[self.link[v]]
            self.suffixes[v] = up + self.finished[v] if self.finished[v] else up
        n = max(len(self.vocabulary), 1)
        self.pairs = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *(p[:-1].astype(np.int64) * n + p[1:] for p in self.phrases)]))

    def _state(self, length: int, link: int, to: dict, place: tuple[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.to.append(to)
        self.place.append(place)
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """A state for p's run with w after it, which q holds among longer ones."""
        new = self._state(self.length[p] + 1, self.link[q], dict(self.to[q]), self.place[q])
        self.link[q] = new
        while p != -1 and self.to[p].get(w) == q:
            self.to[p][w] = new
            p = self.link[p]
        return new

    def _add(self, last: int, w: int, place: tuple[int, int]) -> int:
        """The state of last's run with w after it, made where it is missing."""
        q = self.to[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new = self._state(self.length[last] + 1, 0, {}, place)
        p = last
        while p != -1 and w not in self.to[p]:
            self.to[p][w] = new
            p = self.link[p]
        if p != -1:
            q = self.to[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The words' numbers in the vocabulary; -1 where a word isn't in it."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def stretches(self, words: np.ndarray, row: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
        """The places from..to of maximal stretches, of at least ``least`` words, whose neighbouring pairs are all pairs of phrases."""
        if not len(words):
            return
        known = words >= 0
        joined = np.zeros(len(words), dtype=bool)  # with the word before it
        both = known[1:] & known[:-1] & (row[1:] == row[:-1])
        at = np.flatnonzero(both)
        code = words[at].astype(np.int64) * max(len(self.vocabulary), 1) + words[at + 1]
        joined[at[np.isin(code, self.pairs)] + 1] = True
        begin = np.flatnonzero(known & ~joined)
        # a stretch ends where the next word isn't joined to it
        end = np.flatnonzero(known & ~np.append(joined[1:], False)) + 1
        wide = end - begin >= least
        yield from zip(begin[wide].tolist(), end[wide].tolist(), strict=True)

    def statistics(self, words: Iterable[int]) -> Iterator[tuple[int, int]]:
        """For each word: the length of the longest run in a phrase that ends there, and its state."""
        to, link, length = self.to, self.link, self.length
        state = size = 0
        for w in words:
            while state and w not in to[state]:
                state = link[state]
                size = length[state]
            state = to[state].get(w, 0)
            size = size + 1 if state else 0
            yield size, state

    def at_length(self, n: int) -> list[int]:
        """For each state, the state of its run's last n words; 0 where its run is shorter."""
        out = [0] * len(self.length)
        for v in self.by_length:
            if self.length[v] >= n:
                up = self.link[v]
                out[v] = out[up] if self.length[up] >= n else v
        return out

    def holders(self, least: int) -> list[set[int]]:
        """For each state with a run of at least ``least`` words, the phrases that hold it."""
        held: list[set[int]] = [set() for _ in self.length]
        for k, words in enumerate(self.phrases):
            state = 0
            for w in words.tolist():
                state = self.to[state][w]
                held[state].add(k)
        for v in reversed(self.by_length):
            if self.length[self.link[v]] >= least:
                held[self.link[v]] |= held[v]
        return held


def phrase(text: str | None) -> np.ndarray:
    """The hashes of a text's words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; none for null."""
    import pyarrow as pa

    for run in tx.runs(pa.array([text or ""], type=pa.large_string())):
        starts, ends, _ = run.spans(tx.ALNUM)
        return run.hashes(starts, ends, lower=True)
    return np.zeros(0, dtype=tx.U64)


def words(run: tx.Run) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes and first indices of a run's words, as :func:`phrase` takes them."""
    starts, ends, first = run.spans(tx.ALNUM)
    return starts, ends, run.hashes(starts, ends, lower=True), first
