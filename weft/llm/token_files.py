"""Token ids as Arrow files of fixed-size-list batches (operator 6).

A shard is one Arrow IPC file whose batches hold equal-length sequences: ``ids``,
a fixed-size list of unsigned integers, and ``mask``, a fixed-size list of
booleans that is false for the padding after the shard's last token.  Token k of
a shard is place k mod L of sequence k div L, so a reader maps the file and
slices it without copying or decoding.  Documents follow each other in
ascending order of id, over the shards in their order; an index table beside
them says in which shard and at which token of it each document starts.
"""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm import encode as en
from weft.llm import text as tx

#: Tokens of a sequence, and sequences of a batch.
LENGTH, BATCH = 2048, 64

_INDEX = "shard int, path string, doc_id {}, start bigint, n_tokens bigint"


def _open(path: str):
    """The file system of a path and the path in it; a path without a scheme is local."""
    from pyarrow import fs

    url = urlparse(path)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem(), url.path
    return fs.FileSystem.from_uri(path)


class Shard:
    """Writes one shard: ids come in, whole batches of sequences go out."""

    def __init__(self, path: str, wide: bool, length: int, batch: int):
        self.kind = np.uint32 if wide else np.uint16
        self.length, self.room = length, length * batch
        item = pa.uint32() if wide else pa.uint16()
        self.schema = pa.schema([pa.field("ids", pa.list_(item, length)), pa.field("mask", pa.list_(pa.bool_(), length))])
        files, at = _open(path)
        files.create_dir(at.rsplit("/", 1)[0], recursive=True)
        self.file = files.open_output_stream(at)
        self.writer = pa.ipc.new_file(self.file, self.schema)
        self.held, self.n_held, self.total = [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.n_held += len(ids)
        self.total += len(ids)
        if self.n_held >= self.room:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.room * self.room
            for lo in range(0, whole, self.room):
                self._write(flat[lo : lo + self.room], self.room)
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, n: int) -> None:
        mask = np.arange(len(flat)) < n
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)]
        self.writer.write_batch(pa.record_batch(cols, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, dtype=self.kind)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        self.writer.close()
        self.file.close()


class Reader:
    """Random access to a shard's tokens; a local file is mapped, not read."""

    def __init__(self, path: str):
        files, at = _open(path)
        from pyarrow import fs

        self.source = pa.memory_map(at) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(at)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.batch = self.file.get_batch(0).num_rows * self.length if self.file.num_record_batches else 1
        self._at, self._now = -1, None

    def _ids(self, k: int) -> np.ndarray:
        if k != self._at:
            self._at, self._now = k, self.file.get_batch(k).column(0).flatten().to_numpy()  # a view of the file
        return self._now

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Tokens start..start+n of the shard; a view where they lie in one batch."""
        parts = []
        while n > 0:
            k, at = divmod(start, self.batch)
            part = self._ids(k)[at : at + n]
            if not len(part):
                raise EOFError(f"the shard ends before token {start}")
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, dtype=np.uint16), *parts])

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i."""
        k, at = divmod(i, self.batch // self.length)
        batch = self.file.get_batch(k)
        return batch.column(0)[at].values.to_numpy(), batch.column(1)[at].values.to_numpy(zero_copy_only=False)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, spaced: bool = True, wide: bool = False, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, batch: int = BATCH, added: bool = False) -> None:
    """Write all documents' tokens to Arrow shards under ``folder``, and the index to ``folder``/index.

    Documents go in ascending order of id (nulls first, ties by a hash of the
    text), each as its text's ids and ``end_id``; a null or empty text has
    ``end_id`` alone.  ``wide``: ids need more than 16 bits.  ``added``: see :class:`weft.llm.encode.Encoder`.  Each attempt of a
    task writes files of its own, and the index, which Spark commits, names
    those of the attempt that counts: what a lost executor leaves is not read.
    An empty table has an empty index.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    tx.bounded_batches(docs.sparkSession)
    schema = T.StructType.fromDDL(_INDEX.format(own.schema["doc_id"].dataType.simpleString()))
    tie = F.xxhash64("text")
    ordered = own.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)

    def run(batches):
        from pyspark import TaskContext

        encoder, shard, path = en.encoder(tokenizer, end_id, spaced, added), None, ""
        number = TaskContext.get().partitionId()
        for b in batches:
            if shard is None:
                path = f"{folder}/tokens/{number:06d}-{uuid.uuid4().hex}.arrow"
                shard = Shard(path, wide, length, batch)
            for part in tx.runs(b.column(1), en.RUN_BYTES):
                ids, bounds = encoder.run(part)
                before = shard.total
                shard.add(ids)
                n = part.rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, number, dtype=np.int32)), pa.array([path] * n), b.column(0).slice(part.lo, n), pa.array(before + bounds[:-1]), pa.array(np.diff(bounds))], names=schema.names
                )
        if shard is not None:
            shard.close()
        tx.give_back()

    ordered.mapInArrow(run, schema).write.mode("overwrite").parquet(f"{folder}/index")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of :func:`write`'s folder from the shards: doc_id, start (tokens of all documents before it), n_tokens, and its ids as little-endian unsigned 32-bit integers."""
    tx.bounded_batches(spark)
    index = spark.read.parquet(f"{folder}/index")
    sizes = index.groupBy("shard").agg(F.max(F.col("start") + F.col("n_tokens")).alias("n"))  # one row per shard
    base = sizes.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    schema = T.StructType([*index.schema.fields, T.StructField("ids", T.BinaryType())])

    def run(batches):
        path, reader = None, None
        for b in batches:
            ids = []
            for own, start, n in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if own != path:
                    path, reader = own, Reader(own)
                ids.append(reader.tokens(start, n).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, type=pa.binary())], names=schema.names)

    found = index.mapInArrow(run, schema)
    # shards are as many as tasks wrote them: a bounded side
    return found.join(F.broadcast(base), F.col("shard") == F.col("_shard")).select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids")
