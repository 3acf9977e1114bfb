"""Vectorised byte-level text work shared by the document operators.

A document column arrives in Arrow batches.  :func:`chunks` cuts a batch into
runs of whole rows of about a megabyte (a longer text is a run of its own), and
the other helpers find words and lines of a run and hash them with numpy, so no
operator loops over words in Python.  Texts are never cut.  A null text counts
as empty.

Word classes are sets of ASCII bytes; every byte of a non-ASCII character is a
word byte, so byte spans are exactly the spans of the patterns on characters.

Hashes are 64 bits: a polynomial over random byte values modulo 2**64, found by
differences of one running sum, then mixed.  Equal hashes stand for equal words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text worked on at once.
RUN_BYTES = 1 << 19
#: Rows of a batch that Spark hands to Python.
BATCH_ROWS = 512

U64 = np.uint64


def class_of(excluded: Callable[[int], bool]) -> np.ndarray:
    """The byte table of a class that holds all bytes but the excluded ASCII ones."""
    return np.array([b >= 128 or not excluded(b) for b in range(256)])


#: ``[^\x20\x09-\x0D]+``
SPACED = class_of(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text in which A-Z became a-z
ALNUM = class_of(lambda b: not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))

_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3's)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BYTE_LOWER = _BYTE[_LOWER]
_BASE = 0x5851F42D4C957F2D
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, RUN_BYTES + 64), base, dtype=U64)
        out[0] = 1
        have = np.multiply.accumulate(out, dtype=U64)
        if n <= 4 * RUN_BYTES:  # keep what common runs need; a giant text pays for itself
            _powers[base] = have
    return have


class Run:
    """Whole rows ``lo..hi`` of a batch: their bytes and the rows' bounds in them."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, bounds: np.ndarray):
        self.lo, self.hi, self.data, self.bounds = lo, hi, data, bounds
        self._sums: dict[bool, np.ndarray] = {}

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def spans(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of the class, and the index of each row's first (rows + 1 of them)."""
        inside = table[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        at = self.bounds[:-1][self.bounds[:-1] < self.bounds[1:]]  # starts of rows that aren't empty
        first[at] = inside[at]
        at = self.bounds[1:][self.bounds[:-1] < self.bounds[1:]] - 1
        last[at] = inside[at]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the rows' lines (split at newlines; an empty row is one empty line), and each row's first."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.concatenate([self.bounds[:-1], breaks + 1])
        ends = np.concatenate([self.bounds[1:], breaks])
        row = np.concatenate([np.arange(self.rows), np.searchsorted(self.bounds, breaks, "right") - 1])
        order = np.lexsort((starts, row))
        first = np.searchsorted(row[order], np.arange(self.rows + 1))
        starts = starts[order]
        ends = np.append(starts[1:], 0) - 1  # a line ends before the newline that starts the next
        ends[first[1:] - 1] = self.bounds[1:]
        return starts, ends, first

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """The hash of each span."""
        if lower not in self._sums:
            n = len(self.data)
            sums = np.zeros(n + 1, dtype=U64)
            np.cumsum((_BYTE_LOWER if lower else _BYTE)[self.data] * _power(_BASE, n)[:n], out=sums[1:])
            self._sums[lower] = sums
        sums = self._sums[lower]
        return mix((sums[ends] - sums[starts]) * _power(_UNBASE, len(self.data) + 1)[starts])

    def count(self, of: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bytes of a class between neighbouring bounds."""
        return np.diff(np.searchsorted(np.flatnonzero(of[self.data]), bounds))


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from each row's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and bytes of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(n + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bounds = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    return bounds.astype(np.int64), np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)


def runs(column: pa.Array, run_bytes: int = RUN_BYTES) -> Iterator[Run]:
    """The batch's rows in runs of about ``run_bytes``; every row is in one run."""
    bounds, data = strings(column)
    n, lo = len(bounds) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + run_bytes, "right")) - 1)
        hi = min(hi, n)
        yield Run(lo, hi, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
        lo = hi


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of n neighbouring items in a row, and the row of each window."""
    row = row_of(first)
    if len(hashes) < n:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    out = np.zeros(len(hashes) - n + 1, dtype=U64)
    for k in range(n):
        out = out * U64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - n + 1 + k]
    inside = row[: len(out)] == row[n - 1 :]
    return mix(out[inside]), row[: len(out)][inside]


def repeated(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items with a row: whether the item's hash is found twice or more in its row, and whether it was found earlier."""
    twice, earlier = np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes), dtype=bool)
    if len(hashes) > 1:
        key = mix(hashes + row.astype(U64) * U64(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        earlier[order[1:]] = same
        twice[order[1:]] = same
        twice[order[:-1]] |= same
    return twice, earlier


def free_name(columns: list[str], name: str) -> str:
    """A column name that no column has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_batches(spark: SparkSession) -> None:
    """Keep what Spark hands to Python small: batches of at most BATCH_ROWS rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def give_back() -> None:
    """Return a task's freed memory to the system: workers live on, and what one task held must not add to the next's."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


#: What this process keeps from task to task: whose it is, and how to let go of it.
_kept: list = []


def keep(owner: object, release: Callable[[], object]) -> None:
    """This process keeps what ``owner`` made, and lets go of what another kept: workers live on through all operators of a job."""
    if not _kept or _kept[0] is not owner:
        let_go()
        _kept[:] = [owner, release]


def let_go() -> None:
    if _kept:
        release = _kept[1]
        _kept.clear()
        release()
        give_back()


def annotate(docs: DataFrame, text_col: str, make: Callable[[], Callable[[pa.Array], pa.StructArray]], ddl: str, out: str) -> DataFrame:
    """The documents, row by row, with a struct column ``out`` of what ``make()``'s function returns for the text column.

    All columns pass through, so nothing is joined back and repeated rows,
    null ids or columns that bear an output's name do no harm.  ``out`` must be
    a free name (:func:`free_name`).
    """
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.StructType.fromDDL(ddl))])

    def run(batches):
        work = None
        for batch in batches:
            work = work or make()
            found = work(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, out])
        give_back()

    return docs.mapInArrow(run, schema)


def struct(**arrays) -> pa.StructArray:
    """A struct array of equally long arrays."""
    cols = {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in arrays.items()}
    return pa.StructArray.from_arrays(list(cols.values()), names=list(cols))


def binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes between neighbouring bounds as binary values, not copied.

    Not made of memoryviews: Arrow never lets go of one, so a worker would keep the bytes of all batches it ever had.
    """
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.array(bounds).cast(pa.int32()).buffers()[1], pa.py_buffer(data)])


def joined(parts: list[pa.StructArray], ddl_type: pa.DataType | None = None) -> pa.Array:
    """The parts one after another."""
    if not parts:
        return pa.array([], type=ddl_type)
    return pa.concat_arrays(parts)
