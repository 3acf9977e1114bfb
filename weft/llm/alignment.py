"""Cross-tokenizer alignment: two tokenizers' tokens of the same text, cut where both end one (operator 12).

A text is encoded by a byte-level tokenizer (A, of space+text) and a piece tokenizer (B,
which adds that space).  Where the joined bytes of both are space+text, a byte offset
at which tokens of both end is a shared cut.  The cuts are found by divide and conquer: for an
interval of A's tokens the ends are probed from its middle outwards, each by bisection among B's ends; the
interval is split at the first shared one, and both halves go on.  An interval that has none
inside is a leaf: a group of tokens that only correspond as a whole.  All
documents of a run go down together, level by level.

Within a group the tokens that share a byte are linked.  How often two ids are linked is
counted over the whole corpus, and each document gets back what its links are worth.  Documents are
handled in chunks of a few megabytes: a chunk's distinct id pairs are counted once, join
the corpus' counts, and come back to their chunk alone, so what is shuffled
is narrow and no table of pairs is broadcast.
"""

from __future__ import annotations

import hashlib
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from weft.llm import encode as en
from weft.llm import text as tx
from weft.session import scratch_path

#: Bytes of text whose id pairs are counted together.
CHUNK_BYTES = 4 << 20
#: Bytes of text aligned at once.
RUN_BYTES = 1 << 19

_PIECE_SPACE = b"\xe2\x96\x81"


class Pieces(en.Encoder):
    """A piece tokenizer's ids: a text is cut where a space follows something else, as no piece has one behind another character.

    A stretch begins with a space, which stands for the one that the tokenizer adds itself.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{path} has pieces with a space behind another character")
        self.end_id, self.spaced, self.added = -1, True, []
        self.lone = self.model.piece_to_id("▁")
        self._forget()

    def _ids_known(self) -> int:
        return self.model.vocab_size()

    def _stretches(self, run: tx.Run, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        space = run.data == 0x20
        cut = np.zeros(len(space), dtype=bool)
        cut[1:] = space[1:] & ~space[:-1]
        cut[run.bounds[:-1][run.bounds[:-1] < run.bounds[1:]]] = True
        starts = np.flatnonzero(cut)
        return starts, np.append(starts[1:], len(space)), np.searchsorted(starts, run.bounds)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x or [self.lone] for x in self.model.encode([t[1:] for t in texts], num_threads=1)]


def byte_sizes(path: str) -> np.ndarray:
    """How many bytes each id of a byte-level tokenizer file stands for: a character of an entry is a byte."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
    for entry, i in vocab.items():
        out[i] = len(entry)
    return out


def piece_sizes(path: str) -> np.ndarray:
    """How many bytes each id of a piece tokenizer file stands for."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return np.array([1 if model.is_byte(i) else len(model.id_to_piece(i).replace("▁", " ").encode()) for i in range(model.vocab_size())])


def shared_cuts(a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Indices in ``a``, ascending, of the ends that close a group, for intervals ``lo..hi`` of its tokens.

    ``a`` and ``b`` are ascending byte offsets of the two tokenizers' ends, and each
    interval's last end is shared.  An interval is split at the shared end nearest to its middle.
    """
    found = [hi - 1]
    while len(lo):
        last = hi - 1  # the last end closes the interval, so inner ends are lo..last - 1
        lo, last = lo[lo < last], last[lo < last]
        if not len(lo):
            break
        middle, cut = (lo + last - 1) // 2, np.full(len(lo), -1, dtype=np.int64)
        open_, reach = np.arange(len(lo)), 0
        while len(open_):
            for probe in (middle[open_] + reach, middle[open_] - reach)[: 2 if reach else 1]:
                some = (cut[open_] < 0) & (probe >= lo[open_]) & (probe < last[open_])
                at = a[probe[some]]
                hit = b[np.minimum(np.searchsorted(b, at), len(b) - 1)] == at
                cut[open_[some][hit]] = probe[some][hit]
            reach += 1
            open_ = open_[(cut[open_] < 0) & ((middle[open_] + reach < last[open_]) | (middle[open_] - reach >= lo[open_]))]
        split = cut >= 0
        found.append(cut[split])
        lo, hi = np.concatenate([lo[split], cut[split] + 1]), np.concatenate([cut[split] + 1, last[split] + 1])
    return np.sort(np.concatenate(found))


class Aligner:
    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = en.Encoder(byte_path, 0, True), Pieces(piece_path)
        self.size_a, self.size_b = byte_sizes(byte_path), piece_sizes(piece_path)
        self.said = {k: np.array([f"{i}{k}" for i in range(max(len(self.size_a), len(self.size_b)))], dtype=object) for k in (",", "|", ";")}

    def align(self, run: tx.Run) -> dict[str, np.ndarray]:
        """For the rows of a run: numbers of tokens, groups and links, the groups' digest, and the links (row, key of the id pair)."""
        raw = run.data.tobytes()
        texts = [raw[x:y] for x, y in zip(run.bounds[:-1].tolist(), run.bounds[1:].tolist(), strict=True)]
        keep = np.array([bool(t) and _PIECE_SPACE not in t for t in texts], dtype=bool)  # that piece is read as a space: other bytes
        spaced = b"".join(b" " + t for t, k in zip(texts, keep.tolist(), strict=True) if k)
        row = np.flatnonzero(keep)
        bounds = np.concatenate([[0], np.cumsum(np.diff(run.bounds)[row] + 1)]).astype(np.int64)
        own = tx.Run(0, len(row), np.frombuffer(spaced, dtype=np.uint8), bounds)
        out = {"row": row, "n_a": np.zeros(run.rows, dtype=np.int64), "n_b": np.zeros(run.rows, dtype=np.int64), "n_groups": np.zeros(run.rows, dtype=np.int64), "n_links": np.zeros(run.rows, dtype=np.int64)}
        digest = out["groups_sha256"] = np.full(run.rows, "", dtype=object)
        if not len(row):
            return out | {"row": np.zeros(0, dtype=np.int64), "key": np.zeros(0, dtype=np.int64)}
        (a, at_a), (b, at_b) = self._encoded(self.a, own), self._encoded(self.b, own)
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        for ends, at in ((end_a, at_a), (end_b, at_b)):
            if not np.array_equal(ends[at[1:] - 1], bounds[1:]):
                raise ValueError("a tokenizer's bytes are not those of the text")
        cuts = shared_cuts(end_a, end_b, at_a[:-1], at_a[1:])
        cut = np.searchsorted(end_b, end_a[cuts])  # B's tokens that close the groups
        ends = np.union1d(end_a, end_b)  # the bytes between two neighbouring ends are of one token of A and one of B
        first, second = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        of = np.searchsorted(bounds[1:], ends)
        out["n_a"][row], out["n_b"][row] = np.diff(at_a), np.diff(at_b)
        out["n_groups"][row] = np.diff(np.searchsorted(cuts, at_a))
        out["n_links"][row] = np.bincount(of, minlength=len(row))
        # tokens in the order of the groups, A's before B's; what follows a token is told by its place
        group_a, group_b = np.searchsorted(cuts, np.arange(len(a))), np.searchsorted(cut, np.arange(len(b)))
        place_a = np.arange(len(a)) + np.concatenate([[0], cut + 1])[group_a]
        place_b = np.arange(len(b)) + (cuts + 1)[group_b]
        said = np.empty(len(a) + len(b), dtype=object)
        said[place_a], said[place_b] = self.said[","][a], self.said[","][b]
        said[place_a[cuts]], said[place_b[cut]] = self.said["|"][a[cuts]], self.said[";"][b[cut]]
        upto = at_a + at_b
        for r, x, y in zip(row.tolist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True):
            digest[r] = hashlib.sha256("".join(said[x:y].tolist())[:-1].encode()).hexdigest()
        return out | {"row": row[of], "key": a[first] << 32 | b[second]}

    @staticmethod
    def _encoded(encoder: en.Encoder, run: tx.Run) -> tuple[np.ndarray, np.ndarray]:
        """Ids without the end id, and the rows' bounds in them."""
        ids, bounds = encoder.run(run)
        ids = np.delete(ids, bounds[1:] - 1)
        return ids.astype(np.int64), bounds - np.arange(len(bounds))


_held: dict[tuple, Aligner] = {}


def _aligner(*paths: str) -> Aligner:
    """The worker's aligner; loaded once a process."""
    if paths not in _held:
        _held.clear()
        _held[paths] = Aligner(*paths)
    return _held[paths]


_DOC = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def align(docs: DataFrame, byte_path: str, piece_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Aligns all documents and writes two tables below ``folder``; returns them.

    ``documents``: chunk, id, counts, the groups' digest, and the row's links as the indices of its id pairs in the
    chunk (ascending, 4 bytes each) with how often each is linked.  ``pairs``: chunk, index, A's id, B's id, how often the chunk links them.

    Null and empty texts, and texts with U+2581, which B reads as a space, have no
    tokens: zeros.  Null and repeated ids are rows like others.  A long text is a chunk of its own.
    """
    tx.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("chunk", T.LongType()), rows.schema["id"], *T.StructType.fromDDL(f"{_DOC}, pairs binary, times binary, keys binary").fields])

    def run(batches):
        aligner, part, held, size, number = _aligner(byte_path, piece_path), TaskContext.get().partitionId(), [], 0, 0
        for batch in batches:
            for piece in tx.runs(batch.column(1), RUN_BYTES):
                held.append((batch.column(0).slice(piece.lo, piece.rows), aligner.align(piece)))
                size += len(piece.data)
                if size >= CHUNK_BYTES:
                    yield from chunk(held, (part << 32) + number)
                    held, size, number = [], 0, number + 1
        if held:
            yield from chunk(held, (part << 32) + number)
        tx.give_back()

    def chunk(held, number):
        keys, again, times = np.unique(np.concatenate([x["key"] for _, x in held]), return_inverse=True, return_counts=True)
        lo = 0
        for ids, x in held:
            own = again[lo : lo + len(x["key"])]
            lo += len(own)
            pair, n = np.unique(x["row"] * (len(keys) + 1) + own, return_counts=True)
            at = 4 * np.searchsorted(pair, np.arange(len(ids) + 1) * (len(keys) + 1))
            blobs = [(pair % (len(keys) + 1)).astype("<u4").tobytes(), n.astype("<u4").tobytes()]
            cols = [[b[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)] for b in blobs]
            yield batch(0, number, ids, x, cols, None)
        yield batch(1, number, None, None, None, [keys.astype("<u8").tobytes() + times.astype("<u8").tobytes()])

    def batch(kind, number, ids, x, cols, keys):
        n = len(ids) if ids is not None else 1
        none = lambda t: pa.nulls(n, t)
        out = [pa.array([kind] * n, pa.int32()), pa.array([number] * n, pa.int64()), ids if ids is not None else none(id_type)]
        for f in ("n_a", "n_b", "n_groups", "n_links"):
            out.append(pa.array(x[f]) if x else none(pa.int64()))
        out.append(pa.array(x["groups_sha256"], pa.string()) if x else none(pa.string()))
        out += [pa.array(c, pa.binary()) for c in cols] if cols else [none(pa.binary())] * 2
        out.append(pa.array(keys, pa.binary()) if keys else none(pa.binary()))
        return pa.RecordBatch.from_arrays(out, names=schema.names)

    id_type = to_arrow_type(rows.schema["id"].dataType)
    rows.mapInArrow(run, schema).write.partitionBy("kind").parquet(folder)
    written = docs.sparkSession.read.schema(T.StructType([*schema.fields[1:], schema.fields[0]])).parquet(folder)
    found = written.where("kind = 0").select("chunk", "id", *[f.name for f in T.StructType.fromDDL(_DOC)], "pairs", "times")

    def unfold(batches):
        for b in batches:
            for number, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                keys, times = np.frombuffer(raw.as_buffer(), dtype="<u8").reshape(2, -1).astype(np.int64)
                for lo in range(0, len(keys), 1 << 16):
                    k = keys[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), number)), pa.array(np.arange(lo, lo + len(k), dtype=np.int32)), pa.array((k >> 32).astype(np.int32)), pa.array((k & 0xFFFFFFFF).astype(np.int32)), pa.array(times[lo : lo + len(k)])], names=["chunk", "i", "a", "b", "n"])

    pairs = written.where("kind = 1").select("chunk", "keys").mapInArrow(unfold, "chunk bigint, i int, a int, b int, n bigint")
    return found, pairs


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Each id pair's count over the corpus, and whether no other pair of its B id has more (``best``)."""
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("_most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("_most")).alias("best"))


def worth(found: DataFrame, pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """The documents' rows with ``n_best`` (links whose pair is the best of its B id) and ``count_sum`` (the sum of links' counts).

    A chunk's pairs get the corpus' counts by one join, and meet the chunk's documents again in one
    group, which is a few megabytes.
    """
    known = pairs.join(counts, ["a", "b"]).select("chunk", "i", "count", "best")
    columns = [c for c in found.columns if c not in ("chunk", "pairs", "times")]
    schema = T.StructType([*(found.schema[c] for c in columns), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        n = right.num_rows
        count, best = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        i = right["i"].to_numpy()
        count[i], best[i] = right["count"].to_numpy(), right["best"].to_numpy(zero_copy_only=False)
        pair, times = (np.frombuffer(b"".join(left[c].to_pylist()), dtype="<u4").astype(np.int64) for c in ("pairs", "times"))
        size = np.array([len(x) // 4 for x in left["pairs"].to_pylist()], dtype=np.int64)
        upto = np.concatenate([[0], np.cumsum(size)])
        sums = [np.concatenate([[0], np.cumsum(v[pair] * times)]) if n else np.zeros(len(pair) + 1, dtype=np.int64) for v in (best, count)]
        return pa.Table.from_arrays([*(left[c] for c in columns), *(pa.array(s[upto[1:]] - s[upto[:-1]]) for s in sums)], names=schema.names)

    return found.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(meet, schema)


def alignments(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`align`, :func:`pair_counts` and :func:`worth` over all documents; an empty table gives none."""
    folder = scratch_path(docs.sparkSession, f"alignment/{uuid.uuid4().hex}")
    found, pairs = align(docs, byte_path, piece_path, folder, id_col, text_col)
    return worth(found, pairs, pair_counts(pairs))
