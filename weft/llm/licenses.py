"""License scan with a generalised suffix automaton of template words (operator 7)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm import automaton as sa
from weft.llm import text as tx

# The phrases of the base, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Wording that licenses and notices themselves prescribe.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE 2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("isc", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "may not be reproduced, distributed, or transmitted in any form or by any means without the prior written permission"),
)

#: Fewest words of a match that counts; words of text or template that may lie between matches of one chain; least covered share of a template that gives its label.
MATCH, GAP, COVER = 4, 12, 0.8

SCAN = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,a:bigint,b:bigint,cover:double>>"
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("cover", pa.float64())]))
_ARROW = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", _SPAN)])


class Templates:
    def __init__(self, base, templates, match: int, gap: int, cover: float):
        self.phrases = [*((label, words) for words, label in base), *templates]
        self.n_base, self.match, self.gap, self.cover = len(base), match, gap, cover
        hashes = [sa.phrase(t) for _, t in self.phrases]
        self.size = [len(h) for h in hashes]
        self.auto = sa.Automaton(hashes)
        self.held = self.auto.holders(1)
        # where a run that two or more phrases hold ends in each of them
        self.ends: list[dict[int, int]] = [{} for _ in self.auto.length]
        for k, p in enumerate(self.auto.phrases):
            state = 0
            for i, w in enumerate(p.tolist()):
                state = self.auto.to[state][w]
                self.ends[state].setdefault(k, i)
        for v in reversed(self.auto.by_length):
            for k, i in self.ends[v].items():
                self.ends[self.auto.link[v]].setdefault(k, i)
        self.least = min([match, *(n for n in self.size if n)])
        n = max(len(self.auto.vocabulary), 1)
        self.heads = {int(p[0]) * n + int(p[1]) for p in self.auto.phrases[: self.n_base] if 2 <= len(p)}

    def scan(self, run: tx.Run) -> pa.Array:
        _, _, hashes, first = sa.words(run)
        row = tx.row_of(first)
        numbers = self.auto.numbers(hashes)
        n_words = np.diff(first)
        out = [{"n_words": int(n), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "spans": []} for n in n_words]
        base: dict[int, list[tuple[int, int]]] = {}
        found: dict[int, list[tuple[int, int, int]]] = {}
        n = max(len(self.auto.vocabulary), 1)
        for lo, hi in self.auto.stretches(numbers, row, self.least):
            words = numbers[lo:hi].tolist()
            if hi - lo < self.match and not any(a * n + b in self.heads for a, b in zip(words, words[1:], strict=False)) and self.least > 1:
                continue  # shorter than a match, and no phrase of the base begins in it
            r = int(row[lo])
            at = lo - int(first[r])
            stats = list(self.auto.statistics(words))
            for i, (size, state) in enumerate(stats):
                for k in self.auto.suffixes[state]:
                    if k < self.n_base and self.size[k] <= size:
                        base.setdefault(r, []).append((at + i - self.size[k] + 1, k))
                # a match is whole where the next word doesn't lengthen it
                if i + 1 == len(stats) or stats[i + 1][0] <= size:
                    if size >= self.match:
                        found.setdefault(r, []).append((at + i, size, state))
                    for k in self.auto.suffixes[state]:
                        if self.size[k] <= size and self.size[k] < self.match:
                            found.setdefault(r, []).append((at + i, self.size[k], state))
        for r in {*base, *found}:
            row_out, places = out[r], base.get(r, [])
            chains = self.chains(found.get(r, []))
            if places:
                row_out |= {"n_base": len(places), "first_word": min(p for p, _ in places), "last_word": max(p for p, _ in places)}
            names = {self.phrases[k][0] for _, k in places}
            row_out["base_labels"] = ",".join(sorted(names))
            spans = sorted((a, b, self.phrases[k][0], c) for k, a, b, c in chains if c >= self.cover)
            row_out["labels"] = ",".join(sorted(names | {s[2] for s in spans}))
            row_out["spans"] = [{"label": s, "a": a, "b": b, "cover": c} for a, b, s, c in spans]
            row_out["score"] = float(max([1.0 if places else 0.0, *(c for *_, c in chains)]))
        return pa.array(out, type=_ARROW)

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Chains of matches per template: phrase, first and last word + 1 in the text, covered share of the phrase.

        A chain takes the matches of one template in the order of the text, as
        long as they go forward in the template too and leave at most ``gap``
        words out between them on either side.
        """
        each: dict[int, list[tuple[int, int, int]]] = {}
        for end, size, state in matches:
            for k, i in self.ends[state].items():
                each.setdefault(k, []).append((end + 1, i + 1, min(size, self.size[k], i + 1)))
        out = []
        for k, own in each.items():
            own.sort()
            open_, upto, got = None, 0, 0
            begin = end = 0
            for text_end, in_end, size in own:
                if open_ is not None and in_end > upto and text_end > end and text_end - size - end <= self.gap and in_end - size - upto <= self.gap:
                    got += min(size, in_end - upto, text_end - end)
                    upto, end = in_end, text_end
                else:
                    if open_ is not None:
                        out.append((k, begin, end, got / self.size[k]))
                    open_, begin, end, upto, got = True, text_end - size, text_end, in_end, size
            out.append((k, begin, end, got / self.size[k]))
        return out


def scan(docs: DataFrame, text_col: str = "text", out: str = "license", base=BASE, templates=TEMPLATES, match: int = MATCH, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """The documents with a struct of the license wording in them.

    ``n_base``, ``first_word``, ``last_word``, ``base_labels``: all places where
    a phrase of the base stands, the least and largest word at which one starts
    (null without any), and their labels.  ``labels``: these and the labels of
    templates that a chain of matches covers by at least ``cover``; ``spans``:
    those chains, as half-open ranges of words; ``score``: the largest covered
    share of any template, 1 with a place of the base, 0 without a match.  Null
    and empty texts have no words and no labels.  Every row is in the output
    once.
    """
    fixed = (tuple(base), tuple(templates), match, gap, cover)

    def make():
        held = Templates(*fixed)
        return lambda column: tx.joined([held.scan(run) for run in tx.runs(column)], _ARROW)

    return tx.annotate(docs, text_col, make, SCAN, out)
