import itertools
import random

import numpy as np
import pytest

from tests.llm import helpers as h
from weft.llm import neardup as nd


def sets(texts):
    out = []
    for t in texts:
        w = h.words(t)
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else {("blank", t or "")}))
    return out


def brute(ids, texts, alike=0.8):
    s = sets(texts)
    up = list(range(len(s)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    n = [0] * len(s)
    for i, j in itertools.combinations(range(len(s)), 2):
        if len(s[i] & s[j]) >= alike * len(s[i] | s[j]) - 1e-9:
            n[i] += 1
            n[j] += 1
            up[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            r = find(i)
            least[r] = min(d, least.get(r, d))
    return sorted(((d, least.get(find(i)), n[i]) for i, d in enumerate(ids)), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        base = [rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(rng.randrange(4, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "x" + str(rng.randrange(9))
            texts.append(" ".join(w))
    base = [f"hot{i}" for i in range(150)]
    for k in range(60):  # a large group of near copies, and exact ones
        w = list(base)
        w[k] = f"z{k}"
        texts.append(" ".join(w))
    return texts + [" ".join(base)] * 30


def test_links_and_classes_match_brute_force(spark, corpus, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_ROWS", 16)  # the hot group takes several blocks
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id bigint, text string")
    assert sorted(map(tuple, nd.join(docs).collect()), key=str) == brute(range(len(corpus)), corpus)


def test_short_texts_at_another_similarity(spark):
    texts = ["a b c d e f", "a b c d e", "a b c d e f g h", "a b c d", "x b c d e f g h", "q r s t u v w", "q r s t u v z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(map(tuple, nd.join(docs, alike=0.5).collect()), key=str) == brute(range(len(texts)), texts, 0.5)


def test_awkward_rows(spark):
    docs = h.awkward(spark)
    rows = docs.select("doc_id", "text").collect()
    assert sorted(map(tuple, nd.join(docs).collect()), key=str) == brute([r.doc_id for r in rows], [r.text for r in rows])
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert sorted(map(str, texts)) == sorted(map(str, [*h.AWKWARD[:-1]]))  # one of the two equal ones goes


def test_empty_table(spark):
    assert nd.join(h.none(spark)).collect() == []
    assert nd.keep_one(h.none(spark)).collect() == []


def test_keeps_least_id(spark, corpus):
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in nd.keep_one(docs).collect()) == sorted({c for _, c, _ in brute(range(len(corpus)), corpus)})


def test_prefix_is_shortened_until_recall():
    found = np.zeros(nd.BINS)
    found[-1] = 100
    assert nd.next_depth(found, nd.DEEPEST, 0.8, 0.9995) == nd.DEEPEST
    found[0] = 1000
    assert nd.next_depth(found, nd.DEEPEST, 0.8, 0.9995) < nd.DEEPEST
    assert nd.next_depth(np.zeros(nd.BINS), nd.DEEPEST, 0.8, 0.9995) == nd.DEEPEST


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in nd.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}
