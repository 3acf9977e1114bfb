import functools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import helpers as h
from weft.llm import encode as en
from weft.llm import packing, queries, token_files
from weft.llm import text as tx
from weft.session import scratch_path

ODD = ["a   b", "x　  y  z ", "it's  we'll\r\n\r\n  'd 12 345", "ΑΣ ΑΣ. İ", "日本語 テスト  ", "a\x1c b\x85 c", "<|endoftext|> a", "é  Å", "A'S b.c,d!?e"]


def whole(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [x.ids + [2] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def own(encoder, texts, run_bytes=64):
    out = []
    for run in tx.runs(pa.array(texts, type=pa.string()), run_bytes):
        ids, bounds = encoder.run(run)
        out += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]
    return out


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_matches_whole_texts(name, spaced):
    path = queries.tokenizer(name)
    encoder = en.Encoder(path, 2, spaced)
    assert own(encoder, [*h.AWKWARD, *ODD]) == whole(path, [*h.AWKWARD, *ODD])

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet="aB's.! \n\t 　é1#", max_size=25), min_size=1, max_size=4))
    def any_text(texts):
        assert own(encoder, texts) == whole(path, texts)

    any_text()


ADDED = ["one <|endoftext|> two", "one <|ENDOFTEXT|> two", "x<|startoftext|>y's <|endoftext|><|endoftext|>", "<|endof", "text|> a", "<|endoftext|>", "A<|endoftext|>", "a<|endoftext|>", "　<|endoftext|> b"]


@functools.cache
def loaded(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def plain(path, texts):
    return [x.ids + [2] for x in loaded(path).encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_keeps_added_tokens(name, spaced):
    path = queries.tokenizer(name)
    encoder = en.Encoder(path, 2, spaced, added=True)
    texts = [*h.AWKWARD, *ODD, *ADDED]
    assert own(encoder, texts) == own(encoder, texts, 1 << 20) == plain(path, texts)
    assert plain(path, ADDED) != whole(path, ADDED)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|ENDoftext|>", "<|startoftext|>", "<|", "a", "B", " ", "'s", ".", "　"]), max_size=6).map("".join), min_size=1, max_size=4))
    def any_text(texts):
        assert own(encoder, texts) == plain(path, texts)

    any_text()


def test_queries_keep_added_tokens(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(ADDED)), "doc_id bigint, text string")
    monkeypatch.setattr(queries, "texts", lambda *_: docs)
    for query, name in ((queries.op5_packing, "word_bpe_49k.json"), (queries.op6_token_files, "byte_bpe_50k.json")):
        got = {r.doc_id: r.ids_crc32 for r in query(spark, "").collect()}
        assert got == {i: zlib.crc32(np.array(x, dtype="<u4").tobytes()) for i, x in enumerate(plain(queries.tokenizer(name), ADDED))}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing(sizes):
    got_bin, got_at = packing.first_fit(np.array(sizes, dtype=np.int64), 50)
    room, bins, ats = [], [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if k == len(room):
            room.append(50)
        bins[i], ats[i] = k, 50 - room[k]
        room[k] -= sizes[i]
    assert got_bin.tolist() == bins and got_at.tolist() == ats


def test_packing_round_trip(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_TOKENS", 20_000)
    path = queries.tokenizer("word_bpe_49k.json")
    docs = h.awkward(spark, ODD)
    cut = packing.cut(docs.select("doc_id", "text"), path, 2).selectExpr("doc_id", "tokens.doc_tokens", "inline(tokens.pieces)")
    from weft.session import materialize

    packed = packing.pack(materialize(cut)).toPandas()
    ids = {}
    for r in packed.itertuples():
        assert r.length <= 4096 and len(r.ids) == 4 * r.length
        ids.setdefault((r.doc_id, r.doc_tokens), {}).setdefault(r.start, []).append(r.ids)
    rows = docs.select("doc_id", "text").collect()
    expect = whole(path, [r.text for r in rows])
    assert packed.length.sum() == sum(map(len, expect))
    longest = max(expect, key=len)
    parts = next(v for k, v in ids.items() if k[1] == len(longest))
    assert b"".join(parts[s][0] for s in sorted(parts)) == np.array(longest, dtype="<u4").tobytes()
    for _, s in packed.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 4096
    back = packing.sequences(spark.createDataFrame(packed[["length", "ids", "sequence_id", "offset"]])).collect()
    assert sum(len(r.ids) for r in back) == 4 * packed.length.sum()
    laid = packing.layout(docs, path, 2).toPandas()
    assert sorted(laid.ids_crc32) == sorted(zlib.crc32(x) for x in packed.ids)
    assert packing.layout(h.none(spark), path, 2).collect() == []


def test_token_files_round_trip(spark):
    path = queries.tokenizer("byte_bpe_50k.json")
    docs = h.awkward(spark, ODD)
    folder = scratch_path(spark, f"test_tokens/{np.random.default_rng().integers(1 << 60)}")
    token_files.write(docs, folder, path, 2, length=64, batch=4)
    got = sorted(token_files.read(spark, folder).collect(), key=lambda r: r.start)
    rows = docs.select("doc_id", "text").collect()
    assert [r.doc_id is not None for r in got].count(False) == 1 and got[0].doc_id is None
    assert [r.doc_id for r in got[1:]] == sorted(r.doc_id for r in rows if r.doc_id is not None)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    assert sorted(bytes(r.ids) for r in got) == sorted(np.array(x, dtype="<u4").tobytes() for x in whole(path, [r.text for r in rows]))
    index = spark.read.parquet(f"{folder}/index").toPandas()
    for shard, part in index.groupby("path"):
        reader = token_files.Reader(shard)
        total = part.n_tokens.sum()
        masks = [reader.sequence(i)[1] for i in range(-(-total // 64))]
        assert np.concatenate(masks).sum() == total and {len(m) for m in masks} == {64}
        assert reader.sequence(0)[0].tolist() == reader.tokens(0, min(64, total)).tolist() + [0] * max(0, 64 - total)
    empty = scratch_path(spark, f"test_tokens/{np.random.default_rng().integers(1 << 60)}")
    token_files.write(h.none(spark), empty, path, 2)
    assert token_files.read(spark, empty).collect() == []


def test_memory_is_bounded_by_ids(monkeypatch):
    """Texts that must not be cut are not remembered; what is remembered starts anew at a bound, and ids stay the same."""
    path = queries.tokenizer("byte_bpe_50k.json")
    encoder = en.Encoder(path, 2, True)
    wide = [f"w{i}\xa0" + " ".join(f"x{i * 7 + k}" for k in range(400)) for i in range(60)]
    assert own(encoder, wide, 1 << 16) == whole(path, wide)
    assert encoder.used < 1000 and len(encoder.known) < 100
    monkeypatch.setattr(en, "REMEMBERED_IDS", 500)
    narrow = [t.replace("\xa0", " ") for t in wide]
    assert own(encoder, narrow, 1 << 12) == whole(path, narrow)
    assert len(encoder.pool) <= 1 << 16


def test_packing_keeps_ids_beside_nulls(spark):
    big = [1152921504606846977, 4611686018427387907, -(2**63), None, None, 2**63 - 1]
    docs = spark.createDataFrame([(d, f"text {i}") for i, d in enumerate(big)], "doc_id bigint, text string")
    got = packing.layout(docs, queries.tokenizer("word_bpe_49k.json"), 2).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(d for d in big if d is not None)
    assert sum(r.doc_id is None for r in got) == 2 and sorted(r.offset for r in got) == [sum(r.length for r in got) // 6 * k for k in range(6)]
