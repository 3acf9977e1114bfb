import functools
import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import helpers as h
from weft.llm import alignment, queries
from weft.llm import text as tx

A, B = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")
ODD = ["a   b ", " ", "  ", "x　  y\n\n  z ", "it's <|endoftext|> <s> <0x41> é", "日本語 テスト", "a▁b", "\x00 \t\x1c b", "😀😀 ok", "É\xa0\xa0x"]


@functools.cache
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    points = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(p): p for p in points} | {chr(256 + k): p for k, p in enumerate(p for p in range(256) if p not in points)}  # byte-level alphabet
    return a, chars, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(text):
    """Ids and bytes of both tokenizers; none where the bytes differ from space+text."""
    a, chars, b = models()
    if not text:
        return [], []
    ta = [(i, bytes(chars[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    tb = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        tb.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (ta, tb) if b"".join(x for _, x in ta) == want == b"".join(x for _, x in tb) else ([], [])


def plain(texts):
    """Every pair of tokens compared; cuts as a set."""
    found, total = [], Counter()
    for t in texts:
        ta, tb = tokens(t)
        ends = [np.cumsum([len(x) for _, x in s]).tolist() for s in (ta, tb)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        spans = [[(e - len(x), e, i) for e, (i, x) in zip(es, s, strict=True)] for es, s in zip(ends, (ta, tb), strict=True)]
        groups = [[[], []] for _ in cuts]
        for side, s in enumerate(spans):
            for _, y, i in s:
                groups[bisect_left(cuts, y)][side].append(str(i))
        said = [",".join(g) + "|" + ",".join(k) for g, k in groups]
        links = []
        j0 = 0
        for x, y, i in spans[0]:
            while j0 < len(spans[1]) and spans[1][j0][1] <= x:
                j0 += 1
            j = j0
            while j < len(spans[1]) and spans[1][j][0] < y:
                links.append((i, spans[1][j][2]))
                j += 1
        total.update(links)
        found.append((len(ta), len(tb), len(cuts), links, hashlib.sha256(";".join(said).encode()).hexdigest() if ta else ""))
    most = {}
    for (_, j), n in total.items():
        most[j] = max(most.get(j, 0), n)
    return [(a, b, g, len(ls), sum(total[p] == most[p[1]] for p in ls), sum(total[p] for p in ls), sha) for a, b, g, ls, sha in found]


def test_awkward_texts_match_all_pairs(spark):
    docs = h.awkward(spark, ODD).repartition(3)
    rows = docs.select("doc_id", "text").collect()
    want = plain([r.text for r in rows])
    got = alignment.alignments(docs, A, B).collect()
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    assert sorted((tuple(r[c] for c in ("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in got), key=key) == sorted(((r.doc_id, *w) for r, w in zip(rows, want, strict=True)), key=key)
    assert alignment.alignments(h.none(spark), A, B).collect() == []


def test_query_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 20_000)  # in this process only: the chunk's size changes no result
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {r.doc_id: w for r, w in zip(docs, plain([r.text for r in docs]), strict=True)}
    got = queries.op12_alignment(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: tuple(r[1:]) for r in got} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB's.! \n\t 　é1#▁<日😀", max_size=25), min_size=1, max_size=4))
def test_any_text(texts):
    aligner = alignment._aligner(A, B)
    got = [aligner.align(run) for run in tx.runs(pa.array(texts), 64)]
    flat = [x for g in got for x in zip(g["n_a"].tolist(), g["n_b"].tolist(), g["n_groups"].tolist(), g["n_links"].tolist(), g["groups_sha256"].tolist(), strict=True)]
    assert flat == [(*w[:4], w[6]) for w in plain(texts)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 40)), st.sets(st.integers(1, 40))), min_size=1, max_size=4))
def test_cuts_are_the_shared_ends(pairs):
    a, b, lo, hi, at, want = [], [], [], [], 0, []
    for x, y in pairs:
        x, y = x | {41}, y | {41}
        lo.append(len(a))
        want += [len(a) + sorted(x).index(e) for e in sorted(x & y)]
        a += [at + e for e in sorted(x)]
        b += [at + e for e in sorted(y)]
        hi.append(len(a))
        at += 41
    assert alignment.shared_cuts(np.array(a), np.array(b), np.array(lo), np.array(hi)).tolist() == want
