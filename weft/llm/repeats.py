"""Repeated passages: maximal repeat groups from the common-prefix interval tree of an enhanced suffix array (operator 11).

A repeat is a string of at least ``length`` bytes that starts at two places or more, in one
text or in several.  No suffix array over all bytes is built in one place.  The work is divided so that strings
that are equal always meet:

* Each window of ``length`` bytes has an anchor: the place of the least hash among its GRAM-byte strings (the first
  of equal ones).  Equal windows have equal anchors, so they are found under one gram.  Neighbouring windows
  with one anchor make a frame, the bytes of all of them; a window lies in one frame.
* Only hashes go through the first shuffle, about one row in a hundred bytes.  Frames whose gram is found nowhere else
  hold no repeat.  A gram that has one frame only, many times, is a repeat as long as the frame.
* Grams with several frames get one copy of each frame's bytes.  In a task, the suffixes of frames that start
  with equal windows are sorted into a suffix array with the common-prefix lengths of neighbours; a stack
  scan makes the tree of common-prefix intervals, and an interval whose suffixes differ in the byte to the left, or
  begin a frame, is a maximal repeat group.  All suffixes of an interval are its places.
* A gram with more than GROUP frames is divided: each frame into the first and the second half of its windows, and these
  meet again under the hash of the bytes that all windows of the half share.  That is done until groups are small or
  a half is one window, which needs no tree: all its copies are equal.

A repeat over several frames is one group in each of them; their places overlap.  Null texts are empty, and texts
shorter than ``length`` have no windows.  Equal texts are the same text many times.  Hashes of 64 bits stand for grams, two for frames and for
texts.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm import text as tx
from weft.session import scratch_path

#: Bytes of a repeat, at least.
LENGTH = 200
#: Bytes of the strings among which an anchor is chosen.
GRAM = 32
#: Windows looked at at once; a longer text is taken in slices, with the bytes around.
SLICE = 1 << 19
#: Frames under one gram that one task takes, and bytes of frames that it sorts at once.
GROUP, SORTED = 1024, 1 << 21

_FRAME = "gram bigint, frame bigint, k1 bigint, k2 int, start bigint, size smallint, anchor smallint, n int"


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return out if have == width else np.minimum(out[: len(x) - width + 1], out[width - have :])


def frames(run: tx.Run, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """Frames of a run's rows: gram and hash, where they start and end in the run, their rows and the anchors' places in them; slice by slice."""
    width, total = length - GRAM + 1, len(run.data)
    for lo in range(0, total - length + 1, SLICE):
        a = max(lo - 1, 0)  # a window before, and as many behind as a frame may have
        data = run.data[a : lo + SLICE + width + length]
        part = tx.Run(0, 1, data, np.array([0, len(data)]))
        at = np.arange(len(data) - GRAM + 1)
        grams = part.hashes(at, at + GRAM)
        anchor = _least((grams >> tx.U64(32) << tx.U64(32)) | at.astype(tx.U64), width) & tx.U64(0xFFFFFFFF)
        anchor = anchor.astype(np.int64)
        window = np.arange(len(anchor)) + a
        row = np.searchsorted(run.bounds, window, "right") - 1
        anchor[window + length > run.bounds[row + 1]] = -1  # it would leave its text
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(anchor)) + length - 1
        own = (anchor[starts] >= 0) & (starts + a >= lo) & (starts + a < lo + SLICE)
        starts, ends = starts[own], ends[own]
        yield grams[anchor[starts]], part.hashes(starts, ends), starts + a, ends + a, row[starts], anchor[starts] - starts


def _sole(gram: np.ndarray, frame: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first of each row's equal frames, how many there are, and for each frame how many equal ones its row has."""
    key = tx.mix(tx.mix(gram) + frame) ^ tx.mix(row.astype(tx.U64) + tx.U64(1))
    _, first, again, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return first, n, n[again]


def _rows(run: tx.Run, length: int) -> tuple[np.ndarray, ...]:
    parts = list(frames(run, length))
    if not parts:
        return (np.zeros(0, dtype=tx.U64),) * 2 + (np.zeros(0, dtype=np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """The texts with two hashes that stand for each."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.xxhash64(F.lit(11), text).alias("k1"), F.hash(text).alias("k2"), text.alias("text"))


def _found(texts: DataFrame, length: int) -> DataFrame:
    """The distinct frames of each text (k1, k2, text): where the first is, its anchor's place in it, and how many there are."""
    schema = T.StructType.fromDDL(_FRAME)

    def run(batches):
        for b in batches:
            k1, k2 = (b.column(k).to_numpy() for k in (0, 1))
            for part in tx.runs(b.column(2)):
                gram, frame, lo, hi, row, anchor = _rows(part, length)
                first, n, _ = _sole(gram, frame, row)
                gram, frame, lo, hi, row, anchor = (x[first] for x in (gram, frame, lo, hi, row, anchor))
                arrays = (gram.astype(np.int64), frame.astype(np.int64), k1[part.lo + row], k2[part.lo + row], lo - part.bounds[row], (hi - lo).astype(np.int16), anchor.astype(np.int16), n.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=schema.names)
        tx.give_back()

    tx.bounded_batches(texts.sparkSession)
    return texts.mapInArrow(run, schema)


def intervals(lcp: np.ndarray) -> list[tuple[int, int, int, int]]:
    """The common-prefix intervals of a suffix array by a stack scan: (first, behind last, common length, place in the list of the parent or -1).

    ``lcp[i]``: bytes that suffixes i - 1 and i share; ``lcp[0]`` is 0.  Intervals of length 0 are left out; a child comes before its parent.
    """
    out: list[list[int]] = []
    stack: list[list] = [[0, 0, []]]  # first, length, children
    for i, x in enumerate([*lcp[1:].tolist(), 0], 1):
        first, below = i - 1, []
        while stack[-1][1] > x:
            first, size, children = stack.pop()
            out.append([first, i, size, -1])
            for c in children + below:
                out[c][3] = len(out) - 1
            below = [len(out) - 1]
        if x > stack[-1][1]:
            stack.append([first, x, below])
        else:
            stack[-1][2] += below
    return [tuple(x) for x in out]


def maximal(data: np.ndarray, bounds: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Maximal repeat groups within frames ``bounds`` of ``data``; only frames of the same ``group`` (uint64) are compared.

    Returns, for each group, its length, its parent (-1: none) and the bounds of its places, and the places: frame and offset.
    A group's places include those of the groups whose ancestor it is.
    """
    none = np.zeros(0, dtype=np.int64)
    size = np.diff(bounds)
    windows = size - length + 1
    frame = np.repeat(np.arange(len(size)), windows)
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at = bounds[frame] + offset
    run = tx.Run(0, 1, data, np.array([0, len(data)]))
    key = tx.mix(run.hashes(at, at + length) + group[frame])
    left = np.where(offset > 0, data[np.maximum(at - 1, 0)].astype(np.int64), 256 + frame)  # a frame's start is unlike any other
    order = np.argsort(key, kind="stable")
    key, left = key[order], left[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else none
    diverse = np.minimum.reduceat(left, first) != np.maximum.reduceat(left, first) if len(first) else none
    # a class of windows with the same byte to the left holds nothing maximal
    keep = np.repeat(diverse, np.diff(np.append(first, len(key)))).astype(bool)
    order, key, left = order[keep], key[keep], left[keep]
    if not len(order):
        return none, none, np.zeros(1, dtype=np.int64), none, none
    at, frame, offset = at[order], frame[order], offset[order]
    rest = bounds[frame + 1] - at - length
    # the bytes behind the windows, 8 at a time, shorter ones first
    words = int(rest.max()) // 8 + 1
    column = at[:, None] + length + np.arange(8 * words)
    inside = np.arange(8 * words) < rest[:, None]
    tail = np.where(inside, data[np.minimum(column, len(data) - 1)], 0).astype(np.uint8)
    del column, inside
    sort = np.lexsort([rest, *np.ascontiguousarray(tail).view(">u8").T[::-1], key])
    tail, rest, key, left, frame, offset = tail[sort], rest[sort], key[sort], left[sort], frame[sort], offset[sort]
    same = tail[1:] == tail[:-1]
    lcp = np.where(same.all(axis=1), 8 * words, same.argmin(axis=1))
    lcp = np.append(0, np.where(key[1:] == key[:-1], length + np.minimum(lcp, np.minimum(rest[1:], rest[:-1])), 0))
    tree = intervals(lcp)
    if not tree:
        return none, none, np.zeros(1, dtype=np.int64), none, none
    lo, hi, common, parent = np.array(tree).T
    # left extension is diverse where the byte changes between two of the interval's suffixes
    change = np.append(0, np.cumsum(left[1:] != left[:-1]))
    good = change[hi - 1] > change[lo]
    number = np.cumsum(good) - 1
    up = parent.copy()
    while True:  # the nearest ancestor that is maximal itself
        skip = (up >= 0) & ~good[up]
        if not skip.any():
            break
        up[skip] = parent[up[skip]]
    up = np.where(up >= 0, number[up], -1)
    lo, hi, common, up = lo[good], hi[good], common[good], up[good]
    n = hi - lo
    place = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    return common, up, np.append(0, np.cumsum(n)), frame[place], offset[place]


def covered(places: tuple[np.ndarray, ...], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the groups' places cover of each of n frames: frame, start and end of maximal spans."""
    common, _, bounds, frame, offset = places
    if not len(frame):
        return (np.zeros(0, dtype=np.int64),) * 3
    end = offset + np.repeat(common, np.diff(bounds))
    order = np.lexsort((offset, frame))
    frame, offset, end = frame[order], offset[order], end[order]
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(frame * far + end)
    new = np.append(True, frame[1:] * far + offset[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return frame[at], offset[at], reach[np.append(at[1:], len(frame)) - 1] - frame[at] * far


#: A copy of a frame under a gram: the frame it was cut from and where in it, its first place, the anchor's place in it, and the least and greatest
#: distance from a window's start to its anchor under this gram.
_COPY = "gram bigint, frame bigint, root_gram bigint, root_frame bigint, root_start int, k1 bigint, k2 int, start bigint, anchor smallint, lo smallint, hi smallint, bytes binary"


def _squeezed(docs: DataFrame, text_col: str, *more: str) -> DataFrame:
    """k1, k2, the text's bytes compressed, as they go through a shuffle, and other columns."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.select(F.xxhash64(F.lit(11), text).alias("k1"), F.hash(text).alias("k2"), text.alias("text"), *more)
    schema = T.StructType([*keyed.schema.fields[:2], T.StructField("z", T.BinaryType()), *keyed.schema.fields[3:]])

    def run(batches):
        codec = pa.Codec("zstd", compression_level=3)
        for b in batches:
            bounds, data = tx.strings(b.column(2))
            raw = memoryview(data)
            blobs = [codec.compress(raw[x:y], asbytes=True) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            sized = [(y - x).to_bytes(8, "little") + z for x, y, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), blobs, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sized, pa.binary()), *b.columns[3:]], names=schema.names)

    tx.bounded_batches(docs.sparkSession)
    return keyed.mapInArrow(run, schema)


def _whole(z: bytes) -> bytes:
    return pa.decompress(memoryview(z)[8:], int.from_bytes(z[:8], "little"), "zstd", asbytes=True)


def _copies(docs: DataFrame, classes: DataFrame, length: int, text_col: str) -> DataFrame:
    """One copy of each class's frame, with its bytes."""
    asked = classes.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "frame", "start", "size", "anchor")).alias("asked"))  # of one text
    texts = _squeezed(docs, text_col).groupBy("k1", "k2").agg(F.first("z").alias("z"))
    schema = T.StructType.fromDDL(_COPY)

    def run(batches):
        for b in batches:
            for k1, k2, z, frames_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                raw = _whole(z)
                own = frames_.values
                gram, frame, start, size, anchor = (own.field(k) for k in range(5))
                blobs = [raw[x : x + n] for x, n in zip(start.to_pylist(), size.to_pylist(), strict=True)]
                n = len(own)
                same = lambda x, t: pa.array(np.full(n, x), t)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([gram, frame, gram, frame, same(0, pa.int32()), same(k1, pa.int64()), same(k2, pa.int32()), start, anchor, same(0, pa.int16()), same(length - GRAM, pa.int16()), pa.array(blobs, pa.binary())], names=schema.names)
        tx.give_back()

    return asked.join(texts, ["k1", "k2"]).select("k1", "k2", "z", "asked").mapInArrow(run, schema)


_SPAN = "k1 bigint, k2 int, lo bigint, hi bigint"
_PLACE = "repeat bigint, parent bigint, length int, gram bigint, frame bigint, offset int"


def _trees(copies: DataFrame, length: int, spans: bool) -> DataFrame:
    """The trees of all grams of ``copies`` (one of each frame): their groups' places, or (``spans``) what these cover in the copies' texts.

    The frames of a gram come to one task, one gram after another; some megabytes of whole grams are sorted at once.
    """
    schema = T.StructType.fromDDL(_SPAN if spans else _PLACE)

    def work(tables: list[pa.RecordBatch]):
        t = pa.Table.from_batches(tables)
        bounds, data = tx.strings(t["bytes"].cast(pa.large_binary()))
        data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
        gram, own, k1, k2, start = (t[c].to_numpy() for c in ("gram", "frame", "k1", "k2", "start"))
        found = maximal(data, bounds, gram.view(tx.U64), length)
        if spans:
            frame, lo, hi = covered(found, len(gram))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[frame], k2[frame], start[frame] + lo, start[frame] + hi)], names=schema.names)
        common, up, at, frame, offset = found
        n = np.diff(at)
        # a group is named by its places and its length
        head = np.minimum.reduceat(tx.mix(tx.mix(gram[frame].view(tx.U64)) + own[frame].view(tx.U64)) + offset.astype(tx.U64), at[:-1]) if len(n) else np.zeros(0, dtype=tx.U64)
        name = tx.mix(head + common.astype(tx.U64)).view(np.int64)
        parent = pa.array(np.where(up >= 0, name[up], 0) if len(name) else name, mask=up < 0)
        arrays = [pa.array(np.repeat(name, n)), parent.take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.repeat(common, n).astype(np.int32)), pa.array(gram[frame]), pa.array(own[frame]), pa.array(offset.astype(np.int32))]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def run(batches):
        held, size, last = [], 0, None
        for b in batches:
            gram = b.column(0).to_numpy()
            if size >= SORTED and len(gram):  # go on to where the last gram ends
                other = np.flatnonzero(gram != last)
                cut = int(other[0]) if len(other) else len(gram)
                held.append(b.slice(0, cut))
                if cut < len(gram):
                    yield work(held)
                    held, size, b = [], 0, b.slice(cut)
                else:
                    continue
            if b.num_rows:
                held.append(b)
                size += b.nbytes
                last = gram[-1]
        if held:
            yield work(held)
        tx.give_back()

    dealt = copies.select("gram", "frame", "k1", "k2", "start", "bytes").repartition("gram").sortWithinPartitions("gram", "frame")
    return dealt.mapInArrow(run, schema)


def _halved(copies: DataFrame, length: int) -> DataFrame:
    """Each copy as the two halves of its windows, each under the hash of the bytes that all windows of such a half share."""
    schema = copies.schema

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            bounds, data = tx.strings(t["bytes"].cast(pa.large_binary()))
            data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
            gram, frame, root_gram, root_frame, root_start, k1, k2, start, anchor, lo, hi = (t[c].to_numpy().astype(np.int64) for c in schema.names[:-1])
            windows = np.diff(bounds) - length + 1
            run_ = tx.Run(0, 1, data, np.array([0, len(data)]))
            middle = (lo + hi) // 2
            for low, high in ((lo, middle), (middle + 1, hi)):
                first, last = np.minimum(high, anchor), np.maximum(low, anchor - windows + 1)  # distances of the copy's first and last window of the half
                own = np.flatnonzero((first >= last) & (low <= high))
                at = bounds[own] + anchor[own]
                key = run_.hashes(at - low[own], at - high[own] + length)  # from where the last such window begins to where the first ends
                key = tx.mix(key + tx.mix(gram[own].view(tx.U64) + low[own].astype(tx.U64)))
                x, y = at - first[own], at - last[own] + length
                moved = anchor[own] - first[own]
                parts = [data[i:j] for i, j in zip(x.tolist(), y.tolist(), strict=True)]
                blobs = tx.binaries(np.concatenate([data[:0], *parts]), np.concatenate([[0], np.cumsum(y - x)]))
                cols = [key.view(np.int64), run_.hashes(x, y).view(np.int64), root_gram[own], root_frame[own], (root_start[own] + moved).astype(np.int32), k1[own], k2[own].astype(np.int32), start[own] + moved, first[own].astype(np.int16), low[own].astype(np.int16), high[own].astype(np.int16)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), blobs], names=schema.names)
        tx.give_back()

    return copies.mapInArrow(run, schema)


class Repeats:
    """The repeats of a table's texts: written tables of frames below ``folder``, from which :meth:`spans` and :meth:`groups` are made.

    ``members``: the places of all frames whose gram is found twice or more (k1 and k2 stand for a text; the
    first place in a text, ``n`` equal ones there in all its copies), and whether their gram has no other frame (``sole``).  ``classes``: frames of
    grams with several, once each: one of their places, how many there are (``c``) and of the gram (``peers``).
    """

    def __init__(self, docs: DataFrame, length: int = LENGTH, text_col: str = "text", folder: str | None = None):
        if length < 2 * GRAM:
            raise ValueError(f"a repeat has {2 * GRAM} bytes at least")
        spark = docs.sparkSession
        self.docs, self.length, self.text_col, self.spark = docs, length, text_col, spark
        self.folder = folder or scratch_path(spark, f"repeats/{uuid.uuid4().hex}")
        found = _found(_keyed(docs, text_col), length)
        often = found.groupBy("gram").agg(F.sum("n").alias("_n")).where("_n > 1").select("gram")
        kept = found.join(often, "gram").groupBy("gram", "frame", "k1", "k2").agg(F.sum("n").alias("n"), *(F.min(c).alias(c) for c in ("start", "size", "anchor")))
        self.members = self._written(kept, "members")
        classes = self.members.groupBy("gram", "frame").agg(F.sum("n").alias("c"), F.min(F.struct("k1", "k2", "start", "size", "anchor")).alias("at"))
        peers = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("peers"))
        self.classes = self._written(classes.join(peers, "gram").select("gram", "frame", "c", "peers", "at.*"), "classes")

    def _written(self, table: DataFrame, name: str) -> DataFrame:
        table.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _levels(self):
        """For each level: copies whose trees are to be made, and, below the first, all halves with their class's count."""
        mixed = self.classes.where("peers > 1")
        yield _copies(self.docs, mixed.where(F.col("peers") <= GROUP), self.length, self.text_col), None
        crowded = mixed.where(F.col("peers") > GROUP)
        if crowded.isEmpty():
            return
        copies, level = self._written(_copies(self.docs, crowded, self.length, self.text_col), "crowded-0"), 0
        while not copies.isEmpty():
            level += 1
            halves = self._written(_halved(copies, self.length), f"halves-{level}")
            classes = halves.groupBy("gram", "frame").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("k1", "k2", "start")).alias("at"))
            peers = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("peers"), F.sum("c").alias("_c")).where("_c > 1").drop("_c")
            judged = self._written(classes.join(peers, "gram").select("gram", "frame", "c", "peers", "at.*"), f"classes-{level}")
            one = halves.join(judged.where("peers > 1"), ["gram", "frame", "k1", "k2", "start"]).drop("c")
            yield one.where(F.col("peers") <= GROUP), halves.join(judged.where("c > 1").select("gram", "frame", "c"), ["gram", "frame"])
            copies = self._written(one.where(F.col("peers") > GROUP).drop("peers").select(*halves.columns), f"crowded-{level}")

    def spans(self) -> DataFrame:
        """k1, k2, lo, hi: what repeats cover of each text (of equal frames in one text, of the first)."""
        again = self.members.join(self.classes.where("c > 1").select("gram", "frame"), ["gram", "frame"])
        out = again.select("k1", "k2", F.col("start").alias("lo"), (F.col("start") + F.col("size")).alias("hi"))
        for copies, halves in self._levels():
            out = out.unionByName(_trees(copies, self.length, True))
            if halves is not None:
                out = out.unionByName(halves.select("k1", "k2", F.col("start").alias("lo"), (F.col("start") + F.length("bytes")).alias("hi")))
        return out

    def groups(self) -> DataFrame:
        """The maximal repeat groups with all their places: repeat, parent, length, k1, k2, start.

        ``repeat`` names a group, ``parent`` that of the longest shorter repeat at
        these places in the same tree (null: none); a parent's places include its children's.  A place in a text that has several equal frames is
        given for the first of them.  Frames found twice or more as a whole are groups too, without a parent.
        """
        members = self.members.select("gram", "frame", "k1", "k2", "start")
        equal = lambda classes, size: classes.where("c > 1").select(F.xxhash64("gram", "frame").alias("repeat"), F.lit(None).cast("long").alias("parent"), size.cast("int").alias("length"), "gram", "frame", F.lit(0).alias("offset"))
        out = equal(self.classes, F.col("size")).join(members, ["gram", "frame"])
        for copies, halves in self._levels():
            held, found = members, _trees(copies, self.length, False)
            if halves is not None:
                alike = halves.groupBy("gram", "frame").agg(F.first(F.length("bytes")).alias("size"), F.first("c").alias("c"))
                found = found.unionByName(equal(alike, F.col("size")))
                level = self._parts(copies, halves)
                root = members.withColumnsRenamed({"gram": "root_gram", "frame": "root_frame"})
                held = level.join(root, ["root_gram", "root_frame"]).select("gram", "frame", "k1", "k2", (F.col("start") + F.col("root_start")).alias("start"))
            out = out.unionByName(found.join(held, ["gram", "frame"]), allowMissingColumns=True)
        return out.select("repeat", "parent", "length", "k1", "k2", (F.col("start") + F.col("offset")).alias("start")).distinct()

    @staticmethod
    def _parts(copies: DataFrame, halves: DataFrame) -> DataFrame:
        """Which frames the halves of a level were cut from, and where."""
        names = ("gram", "frame", "root_gram", "root_frame", "root_start")
        return copies.select(*names).unionByName(halves.select(*names)).distinct()


_REMOVED = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def remove(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Each document's id with what is left of its text's bytes when all that repeats cover is taken out.

    n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the bytes left), and
    ``kept``, these bytes, if ``texts``.  Every row of the input gives one; a null text is empty.  All copies of a repeat go, the
    first too.
    """
    repeats = Repeats(docs, length, text_col)
    merged = repeats.spans().groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))  # of one text
    rows = _squeezed(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "text", "id")
    joined = rows.join(merged, ["k1", "k2"], "left").select("id", "z", "spans")
    schema = T.StructType([joined.schema["id"], *T.StructType.fromDDL(_REMOVED + (", kept binary" if texts else "")).fields])

    def run(batches):
        for b in batches:
            z, spans = b.column(1).to_pylist(), b.column(2)
            raw = [_whole(x) for x in z]
            out = [_cut(r, s.values, length) for r, s in zip(raw, spans, strict=True)]
            cols = [pa.array([len(r) for r in raw], pa.int64()), *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, *([pa.array([o[3] for o in out], pa.binary())] if texts else [])], names=schema.names)
        tx.give_back()

    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _cut(raw: bytes, spans: pa.Array | None, length: int) -> tuple[int, int, str, bytes]:
    """Removed bytes, runs, the digest of the rest, and the rest, of a text of which ``spans`` are repeats, beside frames equal within it."""
    lo = hi = np.zeros(0, dtype=np.int64)
    if spans is not None:
        lo, hi = spans.field(0).to_numpy(), spans.field(1).to_numpy()
        text = tx.Run(0, 1, np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
        gram, frame, x, y, row, _ = _rows(text, length)
        twice = _sole(gram, frame, row)[2] > 1
        lo, hi = np.concatenate([lo, x[twice]]), np.concatenate([hi, y[twice]])
    if not len(lo):
        return 0, 0, hashlib.sha256(raw).hexdigest(), raw
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    at = np.flatnonzero(np.append(True, lo[1:] > reach[:-1]))
    lo, hi = lo[at], reach[np.append(at[1:], len(lo)) - 1]
    kept = b"".join(raw[x:y] for x, y in zip([0, *hi.tolist()], [*lo.tolist(), len(raw)], strict=True))
    return len(raw) - len(kept), len(lo), hashlib.sha256(kept).hexdigest(), kept
