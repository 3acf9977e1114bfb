import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import helpers as h
from weft.llm import lines as ln
from weft.llm import quality, queries, rules
from weft.llm import text as tx

SF = "/root/testdata/sf0.01"


def base(text):
    s = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", s)
    lines = [x for x in s.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    out = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", s)), len(lines) - len(set(lines)), len(covered))
    return (*out, len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_base_measures(spark):
    more = ["a a a a\n\na a a a\nb", "é|ü  ü\x0bx\n\nx # $ <b>", "one two three " * 40, " ".join(f"w{i}" for i in range(60))]
    docs = h.awkward(spark, more)
    out = rules.verdicts(docs, ln.prior(), out="v")
    assert out.columns == [*docs.columns, "v"]
    rows = out.collect()
    assert len(rows) == len(h.AWKWARD) + len(more)
    for r in rows:
        v = r.v
        assert (v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, v.base_failed) == base(r.text)
        assert len(v.labels) == v.n_lines and not (v.kept and v.base_failed)
    assert rules.verdicts(h.none(spark), ln.prior(), out="v").collect() == []


def sequences(rng, n):
    size = rng.integers(0, 6, n)
    first = np.concatenate([[0], np.cumsum(size)])
    return rng.normal(size=(first[-1], len(ln.FEATURES))), first


def ways(field, x):
    e = x @ field.weights
    for y in itertools.product((0, 1), repeat=len(x)):
        yield y, field.start[y[0]] + sum(e[i] * y[i] for i in range(len(y))) + sum(field.turn[a, b] for a, b in zip(y, y[1:], strict=False))


def test_viterbi_and_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    field = ln.Field(rng.normal(size=len(ln.FEATURES)), rng.normal(size=2), rng.normal(size=(2, 2)))
    x, first = sequences(rng, 40)
    best, (p, passed) = ln.viterbi(field, x, first), ln.marginals(field, x, first)
    turns = np.zeros((2, 2))
    for a, b in itertools.pairwise(first):
        if a == b:
            continue
        found = list(ways(field, x[a:b]))
        assert tuple(best[a:b]) == max(found, key=lambda f: f[1])[0]
        w = np.exp([s for _, s in found])
        w /= w.sum()
        assert np.allclose(p[a:b], sum(np.array(y) * k for (y, _), k in zip(found, w, strict=True)))
        for (y, _), k in zip(found, w, strict=True):
            for c, d in zip(y, y[1:], strict=False):
                turns[c, d] += k
    assert np.allclose(passed, turns)


def test_training_without_lines_gives_the_prior():
    got = ln.train(np.zeros((0, len(ln.FEATURES))), np.zeros(0, dtype=int), np.zeros(1, dtype=int))
    assert np.allclose(got.weights, ln.prior().weights)


def test_long_text_is_read_whole():
    junk = "\n".join(["plain words stand here in a row and end."] * 3 + ["### &&& $$$ ||| ***"] * 4000)
    run = next(tx.runs(pa.array([junk])))
    assert len(ln.Lines(run).length) == 4003
    assert not rules.label(run, ln.prior(), 0.5).to_pylist()[0]["kept"]


@pytest.mark.parametrize("make", [queries.op9_quality, queries.op2_line_rules])
def test_held_out(spark, make):
    got = make(spark, SF).toPandas()
    assert len(got) == 1000
    known = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(got, on="doc_id")
    if "score" in got:
        assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
        own = known[known.held_out]
        assert (own.predicted == own.quality).mean() > 0.95
    else:
        assert (known.kept & ~known.base_failed & (known.quality == 1)).sum() >= 0.98 * (~known.base_failed & (known.quality == 1)).sum()


def test_awkward_quality(spark):
    docs = h.awkward(spark)
    rows = quality.scores(docs, ln.prior(), out="q").collect()
    assert len(rows) == len(h.AWKWARD)
    for r in rows:
        assert 0 <= r.q.score <= 1 and (r.q.n_lines > 0 or (r.q.score == 0 and r.q.worst_line is None))
    field = quality.train(docs, h.labels(spark, [(1, 1, 0), (1, 0, 0), (None, 1, 1), (8, None, 0), (7, 1, 0)]))
    assert np.isfinite(field.weights).all()
    assert quality.scores(h.none(spark), quality.train(h.none(spark), h.labels(spark)), out="q").collect() == []
