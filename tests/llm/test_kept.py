"""A worker keeps what one operator made, not what all operators of a job did."""

import gc
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from weft.llm import encode, neardup, packing, queries, repeats, toxicity
from weft.llm import text as tx


def test_a_tokenizer_takes_the_place_of_an_index():
    one = np.ones(1, dtype=np.int64)
    model = toxicity.Model(np.array([7], dtype=np.uint64), np.zeros(1, dtype=np.int32), np.ones(1, dtype=np.float32), 1.0, one, one, one, np.array([0, 1]), np.zeros(1, dtype=np.int32), one)
    index = model.searched()
    assert model.searched() is index
    encoder = encode.encoder(queries.tokenizer("word_bpe_49k.json"), 2, False)
    assert "held" not in model.__dict__
    assert encode.encoder(queries.tokenizer("word_bpe_49k.json"), 2, False) is encoder
    model.searched()
    assert not encode._held


def test_counting_for_a_model_lets_go_of_a_tokenizer():
    encode.encoder(queries.tokenizer("word_bpe_49k.json"), 2, False)
    assert encode._held
    batch = pa.RecordBatch.from_arrays([pa.array(["a b", None, "b"])], names=["text"])
    assert [b.column(1).to_pylist() for b in toxicity._counts([batch], np.array([7], dtype=np.uint64))] == [[3]]
    assert not encode._held


def grown(work, times=20):
    """Bytes that calls leave behind, of one each."""
    work()
    gc.collect()
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        for _ in range(times):
            work()
        gc.collect()
        return (tracemalloc.get_traced_memory()[0] - before) / times
    finally:
        tracemalloc.stop()


def test_workers_let_go_of_binary_columns(spark, monkeypatch):
    """Pieces, signatures and halves of frames of a batch are gone when the batch is."""
    made = []
    monkeypatch.setattr(tx, "annotate", lambda docs, text_col, make, ddl, out: made.append(make()))
    texts = pa.array([" ".join(f"w{i * k % 97}" for k in range(40)) for i in range(500)])
    packing.cut(None, queries.tokenizer("word_bpe_49k.json"), 2)
    neardup.with_sets(None, "text", "set", signed=True)
    for work in made:
        assert grown(lambda: work(texts)) < 5_000  # noqa: B023

    class Copies:
        schema = T.StructType.fromDDL(repeats._COPY)
        mapInArrow = staticmethod(lambda run, schema: run)  # noqa: N815

    n, run = 500, repeats._halved(Copies, 200)
    raw = np.random.default_rng(5).integers(0, 256, 300 * n, dtype=np.uint8)
    own = [raw[300 * i : 300 * (i + 1)].tobytes() for i in range(n)]
    values = {"anchor": 150, "lo": 0, "hi": 150}
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16()}
    fixed = [pa.array([values.get(f.name, 0)] * n, kinds[f.dataType.simpleString()]) for f in Copies.schema.fields[:-1]]
    batch = lambda: pa.RecordBatch.from_arrays([*fixed, pa.array(own, pa.binary())], names=Copies.schema.names)
    low, high = run([batch()])
    assert low["bytes"].to_pylist() == [x[75:300] for x in own] and high["bytes"].to_pylist() == [x[:274] for x in own]
    alive = pa.total_allocated_bytes()
    del low, high
    grown(lambda: list(run([batch()])))
    gc.collect()
    assert pa.total_allocated_bytes() <= alive


def test_binary_values_are_what_lies_between_bounds():
    assert tx.binaries(np.frombuffer(b"abcdef", dtype=np.uint8), np.array([0, 2, 2, 6])).to_pylist() == [b"ab", b"", b"cdef"]
    assert tx.binaries(np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)).to_pylist() == []
    with pytest.raises(pa.ArrowInvalid):  # more than a column holds
        tx.binaries(np.zeros(0, dtype=np.uint8), np.array([0, 1 << 31]))
