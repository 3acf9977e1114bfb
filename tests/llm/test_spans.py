import hashlib
import random

import pyarrow as pa

from tests.llm import helpers as h
from weft.llm import decontam, licenses
from weft.llm import text as tx


def hits(text, items, window=10):
    w, hit, found = h.words(text), set(), set()
    for i, t in items:
        x = h.words(t)
        if not x:
            continue
        k = min(window, len(x))
        windows = {tuple(x[j : j + k]) for j in range(len(x) - k + 1)}
        for p in range(len(w) - k + 1):
            if tuple(w[p : p + k]) in windows:
                hit |= set(range(p, p + k))
                if i is not None:
                    found.add(i)
    return len(w), len(hit), sorted(found)


def test_windows_match_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        letters = "abcd"[: rng.randint(2, 4)]
        say = lambda n: " ".join(rng.choice(letters) for _ in range(n))  # noqa: E731, B023
        items = [(i if i else None, say(rng.choice([0, 1, 2, 3, 5, 9, 12]))) for i in range(5)]
        docs, n = [say(rng.randint(0, 40)) for _ in range(6)] + [None], rng.choice([2, 3, 10])
        held = decontam.Windows(items, n)
        got = [x for run in tx.runs(pa.array(docs, type=pa.string()), 40) for x in held.scan(run).to_pylist()]
        for d, g in zip(docs, got, strict=True):
            assert (g["n_words"], sum(s["b"] - s["a"] for s in g["words"]), g["items"]) == hits(d, items, n)


def test_find_in_one_or_many_shards(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    items = [(1, passage), (2, "short item here"), (2, "short item here"), (None, "an item without any id of its own stands here now"), (3, None), (4, "")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    more = [f"before {passage.upper()} after", "a short item here", " ".join(f"p{i}" for i in range(5, 15)), "x an item without any id of its own stands here now y"]
    docs = h.awkward(spark, more)
    for shard in (200_000, 4):
        rows = decontam.find(docs, table, out="h", shard_words=shard).collect()
        assert len(rows) == len(h.AWKWARD) + len(more)
        for r in rows:
            assert (r.h.n_words, sum(s.b - s.a for s in r.h.words), list(r.h["items"])) == hits(r.text, items)
            for s, t in zip(r.h.bytes, r.h.words, strict=True):
                assert len(h.words(r.text.encode()[s.a : s.b].decode())) == t.b - t.a
    assert decontam.find(h.none(spark), table, out="h").collect() == []
    assert all(not r.h.words for r in decontam.find(docs, table.limit(0), out="h").collect())


def test_clean_cuts_spans(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    around = " ".join(f"é{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"{around} {passage}. {around}", "k"), (2, passage, "k"), (3, around, None), (4, None, "k")], "doc_id bigint, text string, hits string")
    out = {r.doc_id: r for r in decontam.clean(docs, spark.createDataFrame([(9, passage)], "item_id bigint, text string")).collect()}
    assert {k: r.text for k, r in out.items()} == {1: f"{around} . {around}", 3: around, 4: None}
    assert out[1].hits == "k" and set(out[1].asDict()) == {"doc_id", "text", "hits"}


def base(text):
    w, places = h.words(text), []
    for phrase, label in licenses.BASE:
        x = phrase.split()
        places += [(i, label) for i in range(len(w) - len(x) + 1) if w[i : i + len(x)] == x]
    at = [p for p, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_base_matches_brute_force(spark):
    rng = random.Random(2)
    vocabulary = "cc by general public license all rights reserved the of software".split()
    more = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))).title() for _ in range(300)]
    rows = licenses.scan(h.awkward(spark, more), out="l").collect()
    assert len(rows) == len(h.AWKWARD) + 300
    for r in rows:
        x = r.l
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == base(r.text)
        assert set(filter(None, x.base_labels.split(","))) <= set(filter(None, x.labels.split(","))) and 0 <= x.score <= 1
    assert licenses.scan(h.none(spark), out="l").collect() == []


def test_license_chains(spark):
    gap = "Permission is hereby granted, FREE of charge, to any person obtaining a (second) copy of this software and associated documentation files, to deal in the Software without restriction"
    texts = ["x\nReleased under the MIT License.", gap, "Licensed under CC BY-NC 4.0", "granted copy of the software", "permission is hereby granted to no one"]
    got = [r.l for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), out="l").orderBy("doc_id").collect()]
    assert [x.labels for x in got] == ["mit", "mit", "cc-by,cc-by-nc", "", ""]
    assert got[0].score == 1 and got[0].spans[0].a == 1 and got[0].spans[0].b == 6 and got[1].score > 0.9 and got[4].score < 0.5


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
