import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import helpers as h
from weft.llm import queries, repeats
from weft.llm import text as tx


def plain(texts, length):
    """Every window of every text counted."""
    raw = [(t or "").encode() for t in texts]
    n = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, dtype=int)
        for i in range(len(r) - length + 1):
            if n[r[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(r, dtype=np.uint8)[~gone].tobytes()
        out.append((len(r), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed, n=60):
    """Texts with shared passages, near and exact copies, periodic stretches and passages within one text."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(r.randint(20, 90)) for _ in range(6)]
    out = [None, "", "short", "a" * 900, "ab" * 300 + prose(30), "x" * 199, "y" * 200, "z" * 201, shared[0][:150]]
    for _ in range(n):
        parts = [prose(r.randint(5, 60)) for _ in range(r.randint(1, 3))] + [r.choice(shared)[r.randint(0, 40) :] for _ in range(r.randint(0, 2))]
        r.shuffle(parts)
        out.append(" ".join(parts))
    for t in out[12:30]:
        k = r.randint(0, max(len(t) - 1, 0))
        out += [t[:k] + "#" + t[k + 1 :], t[k:], t] if r.random() < 0.7 else [t + t]
    return out


def got(spark, texts, length):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    return {r.doc_id: tuple(r[1:]) for r in repeats.remove(docs, length).collect()}


@pytest.mark.parametrize(("length", "group"), [(200, 1024), (100, 4)])
def test_removed_bytes_match_all_windows(spark, monkeypatch, length, group):
    """Also where grams with more than a few frames are divided."""
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "SORTED", 1 << 12)
    texts = passages(length)
    want = plain(texts, length)
    have = got(spark, texts, length)
    assert [have[i] for i in range(len(texts))] == want and sum(w[1] for w in want) > 10_000


def test_groups_have_all_places(spark, monkeypatch):
    """Every window found twice lies in a group, and each group's places are all places of its string."""
    for group in (1024, 3):
        monkeypatch.setattr(repeats, "GROUP", group)
        texts = passages(7, 30)
        docs = spark.createDataFrame([(t,) for t in texts], "text string")
        keys = {(r.k1, r.k2): r.text.encode() for r in repeats._keyed(docs, "text").collect()}
        found = defaultdict(set)
        parents = {}
        for r in repeats.Repeats(docs, 100).groups().collect():
            found[r.repeat, r.length].add((r.k1, r.k2, r.start))
            parents[r.repeat] = r.parent
        places = defaultdict(set)
        for k, raw in keys.items():
            for i in range(len(raw)):
                places[raw[i : i + 100]].add((*k, i))
        lengths = {name: n for name, n in found}
        for (name, n), own in found.items():
            strings = {keys[p[:2]][p[2] : p[2] + n] for p in own}
            assert len(strings) == 1 and len(next(iter(strings))) == n
            if parents[name] is not None:
                assert own <= found[parents[name], lengths[parents[name]]] and lengths[parents[name]] < n
        window = {p for w in places.values() if len(w) > 1 for p in w if p[2] + 100 <= len(keys[p[:2]])}
        inside = {(k1, k2, i) for (_, n), own in found.items() for k1, k2, s in own for i in range(s, s + n - 99)}
        alone = {(*k, i) for k, raw in keys.items() for i in range(len(raw) - 99) if raw.count(raw[i : i + 100]) > 1 or raw.find(raw[i : i + 100], i + 1) > 0 or raw.find(raw[i : i + 100]) < i}
        assert window - alone <= inside


def test_awkward_rows(spark):
    docs = h.awkward(spark, ["q" * 5000, h.LONG[:300_000]])
    rows = docs.select("doc_id", "text").collect()
    want = plain([r.text for r in rows], 200)
    have = repeats.remove(docs).collect()
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    assert sorted(map(tuple, have), key=key) == sorted(((r.doc_id, *w) for r, w in zip(rows, want, strict=True)), key=key)
    assert repeats.remove(h.none(spark)).collect() == []


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {r.doc_id: w for r, w in zip(rows, plain([r.text for r in rows], 200), strict=True)}
    assert {r.doc_id: tuple(r[1:]) for r in queries.op11_repeats(spark, "/root/testdata/sf0.001").collect()} == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=30))
def test_intervals_match_their_definition(lcp):
    lcp = np.array([0, *lcp])
    want = set()
    for i in range(len(lcp)):
        for j in range(i + 2, len(lcp) + 1):
            low = min(lcp[i + 1 : j])
            if low > 0 and lcp[i] < low and (j == len(lcp) or lcp[j] < low):
                want.add((i, j, low))
    tree = repeats.intervals(lcp)
    assert {t[:3] for t in tree} == want and len(tree) == len(want)
    for i, j, low, up in tree:
        above = [t for t in want if t[0] <= i and j <= t[1] and t != (i, j, low)]
        assert (tree[up][:3] if up >= 0 else None) == (min(above, key=lambda t: t[1] - t[0]) if above else None)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=400), min_size=1, max_size=5), st.integers(64, 90))
def test_frames_hold_each_window_once(texts, length):
    for run in tx.runs(pa.array(texts), 500):
        gram, frame, lo, hi, row, anchor = repeats._rows(run, length)
        windows = [(r, i) for r, a, b in zip(row.tolist(), lo.tolist(), hi.tolist(), strict=True) for i in range(a, b - length + 1)]
        assert sorted(windows) == [(r, int(i)) for r in range(run.rows) for i in range(run.bounds[r], run.bounds[r + 1] - length + 1)]
