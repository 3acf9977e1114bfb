"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups (operator 5)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm import encode as en
from weft.llm import text as tx
from weft.session import materialize

#: Most tokens of a sequence.
CAPACITY = 4096
#: Tokens of a group that is packed by itself, about.
GROUP_TOKENS = 1 << 21

_PIECES = "doc_tokens bigint, pieces array<struct<start:bigint,length:bigint,ids:binary>>"
_PIECE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
_ARROW = pa.struct([("doc_tokens", pa.int64()), ("pieces", pa.list_(_PIECE))])


def cut(docs: DataFrame, tokenizer: str, end_id: int, spaced: bool = False, text_col: str = "text", capacity: int = CAPACITY, out: str = "tokens", added: bool = False) -> DataFrame:
    """The documents with a struct of their tokens: ``doc_tokens`` and the pieces of at most ``capacity`` ids.

    A document's ids are its text's and ``end_id``; a null or empty text has
    ``end_id`` alone.  ``added``: see :class:`weft.llm.encode.Encoder`.  A piece has its ``start`` in the document, its
    ``length``, and its ids as little-endian unsigned 32-bit integers.
    """

    def make():
        def work(column: pa.Array) -> pa.Array:
            encoder, parts = en.encoder(tokenizer, end_id, spaced, added), []
            for run in tx.runs(column, en.RUN_BYTES):
                ids, bounds = encoder.run(run)
                n = np.diff(bounds)
                each = -(-n // capacity)
                row = np.repeat(np.arange(run.rows), each)
                upto = np.concatenate([[0], np.cumsum(each)])
                start = (np.arange(len(row)) - upto[row]) * capacity
                length = np.minimum(n[row] - start, capacity)
                blobs = tx.binaries(ids.astype("<u4").view(np.uint8), 4 * np.append(bounds[row] + start, len(ids)))  # pieces follow each other
                pieces = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.StructArray.from_arrays([pa.array(start), pa.array(length), blobs], fields=list(_PIECE)))
                parts.append(pa.StructArray.from_arrays([pa.array(n), pieces], fields=list(_ARROW)))
            return tx.joined(parts, _ARROW)

        return work

    return tx.annotate(docs, text_col, make, _PIECES, out)


def first_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: first-fit decreasing (ties: in the order given).

    The tree holds, over each range of bins, the largest room of one; the first
    bin with room for an item is found by going down from its root, left where
    the left half has room.
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    leaves = 1 << max(0, (n - 1)).bit_length()
    room = [capacity] * (2 * leaves)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bins[i], offsets[i] = at - leaves, capacity - room[at]
        room[at] -= size
        while at > 1:
            at //= 2
            best = room[2 * at] if room[2 * at] >= room[2 * at + 1] else room[2 * at + 1]
            if room[at] == best:
                break
            room[at] = best
    return bins, offsets


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, seed: int = 5) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: their places in sequences of at most ``capacity`` tokens.

    ``pieces`` must be a table that reads the same each time (a written one).
    Pieces are dealt at random into groups of about ``group_tokens`` tokens, so
    equal rows or ids don't gather, and each group is packed by itself.  A
    sequence is filled from 0 without gaps; its number holds its group's in the
    upper half.  Lengths must be 1 to ``capacity``.  An empty table gives none.
    """
    total = pieces.agg(F.sum(length_col)).first()[0] or 0
    groups = max(1, math.ceil(total / group_tokens))
    name = tx.free_name(pieces.columns, "_group")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fill(key: tuple, group: pa.Table) -> pa.Table:  # Arrow: a null id must not make numbers of the others
        own = group.drop_columns([name]).combine_chunks()
        whole = [c for c in own.column_names if pa.types.is_integer(own.schema.field(c).type)]
        order = np.arange(len(own))
        for c in whole:  # else the order follows the shuffle; nulls first
            column = own[c].take(pa.array(order))
            order = order[np.lexsort([column.fill_null(0).to_numpy(), column.is_valid().to_numpy()])]
        own = own.take(pa.array(order))
        bins, offsets = first_fit(own[length_col].to_numpy(), capacity)
        return own.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    dealt = pieces.withColumn(name, F.floor(F.rand(seed) * groups).cast("int"))
    return dealt.groupBy(name).applyInArrow(fill, schema)


def sequences(packed: DataFrame, ids_col: str = "ids") -> DataFrame:
    """Packed pieces that still carry their ids, as one row per sequence: its ids and the bounds of its pieces."""
    own = F.sort_array(F.collect_list(F.struct("offset", F.col("length"), F.col(ids_col).alias("ids"))))  # a sequence is bounded
    whole = packed.groupBy("sequence_id").agg(own.alias("p"))
    return whole.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.transform("p", lambda x: x["length"]).alias("lengths"))


def layout(docs: DataFrame, tokenizer: str, end_id: int, spaced: bool = False, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, added: bool = False) -> DataFrame:
    """Where each piece of each document goes, with the crc32 of its ids in place of them.

    Tokens are made and digested in one pass; only the narrow table of pieces
    is written and shuffled.
    """
    cut_ = cut(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), tokenizer, end_id, spaced, capacity=capacity, added=added)
    pieces = cut_.select("doc_id", "tokens.doc_tokens", F.inline("tokens.pieces")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(materialize(pieces), capacity=capacity)
