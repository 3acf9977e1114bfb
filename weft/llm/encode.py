"""Whole texts to token ids with a public tokenizer file, each distinct stretch of text encoded once.

Byte-pair tokenizers split a text before they merge, and never merge across the
place where white space begins, nor where letters end and punctuation begins.  So a text is cut there (where
ASCII white space or punctuation follows something else or an ASCII letter), the distinct stretches of a run of documents are found by their
hashes, and only those not met before go to the tokenizer; the ids of all the
others are gathered with numpy.  A text with white space beyond ASCII, where that
cut could change how neighbouring white space is split, is encoded as one stretch;
so is one with the string of an added token, where such strings aren't ordinary text.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from weft.llm import text as tx

#: Stretches that a worker remembers, and ids of them, at most; beyond either the memory starts anew.
REMEMBERED, REMEMBERED_IDS = 3 << 19, 1 << 23
#: Bytes of a stretch that is worth remembering; a longer one, such as a text that must not be cut, is encoded each time.
LONGEST = 256
#: Bytes of text encoded at once: a stretch that comes again in them is looked up once.
RUN_BYTES = 1 << 20

_SPACE = ~tx.SPACED
_ASCII_LETTER = np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B)])
_POINT = np.isin(np.arange(256), [b for b in range(0x21, 0x7F) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)])
_WIDE = ((0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A, 0x80), (0xE2, 0x81, 0x9F), (0xE3, 0x80, 0x80), *((0xE2, 0x80, b) for b in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)))


class Encoder:
    """``spaced``: white space and case count for ids; else white space only parts words and is left out of the stretches, and A-Z are as a-z.

    ``added``: the string of an added token in a text is that token, as the file says; else it is ordinary text.
    """

    def __init__(self, path: str, end_id: int, spaced: bool, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.end_id, self.spaced = end_id, spaced
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, dtype=tx.U64)
        self.begin, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)  # of the ids, in the order of known
        self.pool = np.zeros(1 << 16, dtype=np.uint16 if self._ids_known() <= 1 << 16 else np.int32)
        self.used = 0

    def _ids_known(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _tokens(self, run: tx.Run) -> np.ndarray:
        """Rows with the string of an added token, in any case."""
        found, raw = [], run.data.tobytes().lower() if self.added else b""
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(run.bounds, at, "right")) - 1
                if at + len(token) <= run.bounds[row + 1]:
                    found.append(row)
                    at = raw.find(token, int(run.bounds[row + 1]))
                else:  # the end of a row and the start of the next
                    at = raw.find(token, at + 1)
        return np.unique(np.array(found, dtype=np.int64))

    def _stretches(self, run: tx.Run, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = run.data
        ends_word = np.zeros(len(data), dtype=bool)
        ends_word[1:] = _POINT[data[1:]] & _ASCII_LETTER[data[:-1]]  # a point right after a letter
        if self.spaced:
            space = _SPACE[data]
            ends_word[1:] |= space[1:] & ~space[:-1]
            ends_word[run.bounds[:-1][run.bounds[:-1] < run.bounds[1:]]] = True
            starts = np.flatnonzero(ends_word)
            first = np.searchsorted(starts, run.bounds)
            ends = np.append(starts[1:], len(data))
        else:
            word_s, word_e, _ = run.spans(tx.SPACED)
            ends_word[word_s] = True
            starts = np.flatnonzero(ends_word)
            first = np.searchsorted(starts, run.bounds)
            ends = np.append(starts[1:], len(data))
            if len(word_s):
                last = np.append(np.searchsorted(starts, word_s)[1:], len(starts)) - 1  # each word's last stretch
                ends[last] = word_e
        rows = np.union1d(self._wide(run), tokens)
        if len(rows):
            keep = ~np.isin(tx.row_of(first), rows)
            starts = np.concatenate([starts[keep], run.bounds[rows]])
            ends = np.concatenate([ends[keep], run.bounds[rows + 1]])
            order = np.argsort(starts, kind="stable")
            starts, ends = starts[order], ends[order]
            first = np.searchsorted(starts, run.bounds)
        return starts, ends, first

    @staticmethod
    def _wide(run: tx.Run) -> np.ndarray:
        """Rows with white space beyond ASCII."""
        data, found = run.data, []
        lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
        for code in _WIDE:
            at = lead[lead + len(code) <= len(data)]
            for k, b in enumerate(code):
                at = at[data[at + k] == b]
            found.append(at)
        return np.unique(np.searchsorted(run.bounds, np.concatenate(found), "right") - 1)

    def _learn(self, run: tx.Run, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = run.data.tobytes()
        ids = self._ids([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter(chain.from_iterable(ids), dtype=self.pool.dtype, count=int(size.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        begin = self.used + np.cumsum(size) - size
        self.used += len(flat)
        at = np.searchsorted(self.known, keys)  # keys are ascending
        self.known = np.insert(self.known, at, keys)
        self.begin, self.size = np.insert(self.begin, at, begin), np.insert(self.size, at, size)

    def run(self, run: tx.Run) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a run's rows, each row's closed with the end id, and the rows' bounds in them."""
        tokens = self._tokens(run)
        starts, ends, first = self._stretches(run, tokens)
        hashes = run.hashes(starts, ends, lower=not self.spaced)
        if len(tokens):  # the case of an added token counts
            at = first[tokens]
            hashes[at] = tx.mix(run.hashes(starts[at], ends[at]) + tx.U64(1))
        keys, place, again = np.unique(hashes, return_index=True, return_inverse=True)
        starts, ends = starts[place], ends[place]
        if len(self.known) + len(keys) > REMEMBERED or self.used > REMEMBERED_IDS:
            self._forget()
        at = np.searchsorted(self.known, keys)
        new = np.ones(len(keys), dtype=bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != keys[inside]
        long = new & (ends - starts > LONGEST)
        new &= ~long
        if new.any():
            self._learn(run, keys[new], starts[new], ends[new])
        kept = self.known, self.begin, self.size, self.used
        if long.any():
            self._learn(run, keys[long], starts[long], ends[long])
        at = np.searchsorted(self.known, keys)
        begin, size = self.begin[at][again].astype(np.int64), self.size[at][again].astype(np.int64)
        self.known, self.begin, self.size, self.used = kept
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
        bounds = upto[first] + np.arange(run.rows + 1)
        if len(self.pool) > 4 * REMEMBERED_IDS:  # a giant text was encoded
            self._forget()
        return np.insert(ids.astype(np.int32), upto[first[1:]], self.end_id), bounds


_held: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int, spaced: bool, added: bool = False) -> Encoder:
    """The worker's encoder for a tokenizer file; loaded once a process."""
    key = (path, end_id, spaced, added)
    if key not in _held:
        _held.clear()
        tx.keep(_held, _held.clear)
        _held[key] = Encoder(*key)
    return _held[key]
