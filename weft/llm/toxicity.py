"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index (operator 3).

A term is a word (A-Z lower-cased, ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``) or the first
PREFIX bytes of a longer one.  Vectors hold every term of a text, weighted by
(1 + ln tf) times an IDF over all documents, and have length 1; a term that no sampled example has lengthens
its document's vector as one that no other document has.  What the labels
of a bounded sample say about a term (likelihood ratio G2, and a ratio of rates)
scales its weight between FLOOR and 1; it leaves no term out.

Examples with equal text are one entry with the numbers of its copies and of the positive ones.  Entries
lie in blocks, clusters of their vectors.  For each term the index knows its largest weight in each block that
has it, so a block's best possible cosine with a query is known before
it is read.  Queries with the same best block are searched together.  The best block is read first, then those that
could still better the K-th neighbour: terms that many of the queries and many of a block's entries have are laid out as a matrix and multiplied, and where these and the bound of the others
can't reach the K-th neighbour, no other posting is read.  Cosines are then summed anew: the K nearest are exact.  All examples
as near as the K-th vote, so that many as are beyond K with a smaller weight each; no order among
equals plays a part.  Votes count with the square of the cosine, beside a prior; the share of the positive votes is made a
probability by a logistic curve fitted to the examples' own leave-one-out votes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm import automaton as sa
from weft.llm import lines as ln
from weft.llm import text as tx

#: Labelled documents that are read for terms and examples, at most.
SAMPLE = 20_000
#: G2 up to which a label's hold on a term may be chance (one term in a thousand has it), and from which it counts in full (one in a million).
CHANCE, SIGNIFICANT = 10.83, 24.0
#: How many times likelier a term is under one label than under the other where that counts in full.
RATIO = 10.0
#: Share of its weight that a term keeps which says nothing about the labels.
FLOOR = 0.05
#: Bytes of a prefix term.
PREFIX = 5
#: Neighbours that vote, votes of the prior.
K, PRIOR = 10, 1.0
#: A term that no more than one in DENSE entries of a block has is never laid out there.
DENSE = 64
#: What takes as long as the addition of one posting to a query's scores, one over it: multiplying cells of a matrix for a query; for how many queries' products a matrix is laid out.
CELLS, LAYOUT = 200, 8
#: Cells of a matrix at most, postings added together, and terms of queries that wait to be searched together.
MATRIX, PART, WAITING = 1 << 20, 1 << 13, 1 << 20
#: Queries searched together; how far sums of single precision may be off; steps in which the weights of postings are held.
ROWS, ROUNDING, STEP = 128, 1e-5, 1 / 65535
#: Entries whose postings are made together.
LAID = 512
#: Clusters that are blocks, entries of a block at most, the commonest terms that tell clusters apart, and rounds of k-means.
CLUSTERS, BLOCK, CLUSTER_TERMS, ROUNDS = 8, 4096, 256, 6
#: Terms whose document counts go through the shuffle together.
SLICE = 1 << 14
#: Texts whose scores a worker remembers.
REMEMBERED = 1 << 13
THRESHOLD = 0.5

SCORE = "score double, predicted int, neighbours array<bigint>, cosines array<double>"


def terms(run: tx.Run) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of a run, repeats included, and their rows."""
    starts, ends, hashes, first = sa.words(run)
    row = tx.row_of(first)
    long = np.flatnonzero(ends - starts > PREFIX)
    heads = run.hashes(starts[long], starts[long] + PREFIX, lower=True) ^ tx.U64(0xA24BAED4963EE407)
    return np.concatenate([hashes, heads]), np.concatenate([row, row[long]])


def _distinct(term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms, ascending, and each term's index among them.

    Terms are sorted with their places in their last bits, faster than places by terms.
    """
    mask = tx.U64((1 << len(term).bit_length()) - 1)
    packed = (term & ~mask) | np.arange(len(term), dtype=tx.U64)
    packed.sort()
    at = (packed & mask).astype(np.intp)
    found, new = term.take(at), np.ones(len(term), dtype=bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    if (new[1:] & ((found[1:] ^ found[:-1]) <= mask)).any():  # terms that differ in their last bits alone may be mixed
        return np.unique(term, return_inverse=True)
    again = np.empty(len(term), dtype=np.int64)
    again[at] = np.cumsum(new) - 1
    return found[new], again


def _counted(run: tx.Run, vocabulary: np.ndarray, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, index (its place, if given) and count of each term of each row, by row and index; terms beyond the vocabulary have indices behind it."""
    term, row = terms(run)
    if not len(term):
        return (np.zeros(0, dtype=np.int64),) * 3
    own, again = _distinct(term)
    code = len(vocabulary) + np.arange(len(own))
    if len(vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
        code = np.where(vocabulary[at] == own, at if place is None else place[at], code)
    width = len(vocabulary) + len(own)
    key, n = np.unique(row * width + code[again], return_counts=True)
    row = key // width
    return row, key - row * width, n


def _vocabulary(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All terms of the sample (text, n, pos), ascending, the scale of each one's weight, and its place when the commonest come first."""
    schema = T.StructType.fromDDL("term bigint, pos bigint, n bigint")

    def run(batches):
        for b in batches:
            n, pos = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for part in tx.runs(b.column(0)):
                term, row = terms(part)
                if not len(term):
                    continue
                order = np.lexsort((row, term))
                term, row = term[order], row[order]
                new = np.ones(len(term), dtype=bool)
                new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
                term, at = term[new], part.lo + row[new]
                head = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(term[head].astype(np.int64)), pa.array(np.add.reduceat(pos[at], head)), pa.array(np.add.reduceat(n[at], head))], names=schema.names)

    total, positive = sample.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("pos"), F.lit(0))).first()
    counts = sample.select("text", "n", "pos").mapInArrow(run, schema).groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).toArrow()  # bounded by the sample
    term = counts["term"].to_numpy().astype(np.int64).astype(tx.U64)
    order = np.argsort(term)
    pos, n = (counts[c].to_numpy()[order].astype(float) for c in ("pos", "n"))
    place = np.empty(len(term), dtype=np.int32)
    place[np.argsort(-n, kind="stable")] = np.arange(len(term), dtype=np.int32)
    return term[order], _scale(pos, n - pos, float(positive), float(total - positive)), place


def _scale(pos: np.ndarray, neg: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """The scale of terms' weights, from the positive and negative examples that hold them and how many of either there are."""
    if not n1 or not n0:
        return np.ones(len(pos))
    n, df = n1 + n0, pos + neg

    def part(seen, of, among):  # a cell's share of G2
        return seen * np.log(np.maximum(seen, 1) * n / np.maximum(of * among, 1))

    g2 = 2 * (part(pos, df, n1) + part(neg, df, n0) + part(n1 - pos, n - df, n1) + part(n0 - neg, n - df, n0))
    ratio = np.abs(np.log((pos + 0.5) / (n1 + 1) * (n0 + 1) / (neg + 0.5))) / np.log(RATIO)
    return FLOOR + (1 - FLOOR) * (np.clip((g2 - CHANCE) / (SIGNIFICANT - CHANCE), 0, 1) * np.clip(ratio, 0, 1)) ** 2


_COUNTS = T.StructType([T.StructField("slice", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("df", T.BinaryType())])


def _counts(batches, vocabulary: np.ndarray):
    """A task's document counts of the terms, in slices, and under -1 how many documents it had."""
    tx.let_go()  # what another operator made is gone before a worker gets the model
    total, n = np.zeros(len(vocabulary), dtype=np.int32), 0
    for b in batches:
        n += b.num_rows
        for part in tx.runs(b.column(0)):
            term = _counted(part, vocabulary)[1]
            np.add.at(total, term[term < len(vocabulary)], np.int32(1))
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([n], pa.int64()), pa.array([b""], pa.binary())], names=_COUNTS.names)
    for k, lo in enumerate(range(0, len(total), SLICE)):
        own = total[lo : lo + SLICE]
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([0], pa.int64()), pa.array([own.astype("<i8").tobytes()], pa.binary())], names=_COUNTS.names)


def _document_counts(docs: DataFrame, text_col: str, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each term of the vocabulary is, and how many there are.

    A task counts into one array and sends it in slices of SLICE terms; tasks that get
    slices add them up as they come.
    """
    schema = _COUNTS

    def add(batches):
        held: dict[int, list] = {}
        for b in batches:
            for k, n, raw in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                own = np.frombuffer(raw, dtype="<i8")
                if k in held:
                    held[k] = [held[k][0] + n, held[k][1] + own]
                else:
                    held[k] = [n, own]
        for k, (n, own) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n], pa.int64()), pa.array([own.tobytes()], pa.binary())], names=schema.names)

    tx.bounded_batches(docs.sparkSession)
    found = docs.select(F.col(f"`{text_col}`")).mapInArrow(lambda batches: _counts(batches, vocabulary), schema).repartition("slice").mapInArrow(add, schema).toArrow()  # as large as the vocabulary
    df, n_docs = np.zeros(len(vocabulary), dtype=np.float32), 0
    for k, n, raw in zip(*(found[c].to_pylist() for c in schema.names), strict=True):
        if k < 0:
            n_docs += n
        else:
            df[k * SLICE : (k + 1) * SLICE] = np.frombuffer(raw, dtype="<i8")
    return df, n_docs


@dataclass
class Model:
    #: Terms' hashes, ascending, and their indices: the commonest first, so that what is known of them lies together.
    vocabulary: np.ndarray
    place: np.ndarray
    #: IDF of the vocabulary's terms by index, scaled, and of any other term.
    idf: np.ndarray
    unseen: float
    #: Entries: the least id of the examples with the text, how many they are, how many positive.
    ids: np.ndarray
    n: np.ndarray
    pos: np.ndarray
    #: Entries' vectors: bounds, term indices, and terms' counts or the weights made of them.
    bounds: np.ndarray
    index: np.ndarray
    count: np.ndarray | None
    weight: np.ndarray | None = None
    #: Where blocks of entries begin, and the last ends.
    cuts: np.ndarray | None = None
    base_rate: float = 0.0
    blank_rate: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def weights(self) -> np.ndarray:
        if self.weight is None:
            self.weight = np.empty(len(self.index), dtype=np.float32)
            for lo in range(0, len(self.ids), 1024):  # in parts, as workers are small
                bounds = self.bounds[lo : lo + 1025]
                own = slice(int(bounds[0]), int(bounds[-1]))
                w = (1 + np.log(self.count[own], dtype=np.float32)) * self.idf[self.index[own]]
                self.weight[own] = w / np.repeat(np.sqrt(np.add.reduceat(w * w, bounds[:-1] - bounds[0])), np.diff(bounds))
        return self.weight

    def __getstate__(self) -> dict:
        """Small, as each executor writes it to its disk: no weights where there are counts, and steps between an entry's terms."""
        state = dict(self.__dict__)
        state.pop("held", None)
        state.pop("sent", None)
        if self.count is not None:
            state["weight"] = None
            step = np.diff(self.index, prepend=self.index.dtype.type(0))
            for name, x in (("index", step), ("count", self.count), ("idf", self.idf)):
                raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)  # like bytes together
                state[name] = (x.dtype, raw.shape, pa.compress(raw.tobytes(), "zstd", asbytes=True))
        return state

    def __setstate__(self, state: dict) -> None:
        for name, x in state.items():
            if isinstance(x, tuple):
                kind, shape, raw = x
                flat = np.frombuffer(pa.decompress(raw, shape[0] * shape[1], "zstd", asbytes=True), dtype=np.uint8)
                state[name] = np.ascontiguousarray(flat.reshape(shape).T).reshape(-1).view(kind)
        if state["count"] is not None:
            state["index"] = np.cumsum(state["index"], dtype=state["index"].dtype)
        self.__dict__.update(state)
        if self.count is not None:
            self.weights()
            self.count = None  # a model that was sent is searched only

    def searched(self) -> Index:
        """The index over the entries; made once a process."""
        if "held" not in self.__dict__:
            _one_thread()
            tx.keep(self, lambda: self.__dict__.pop("held", None))
            tx.give_back()
            self.held = Index(self)
            tx.give_back()
        return self.held


def _one_thread() -> None:
    """Matrix products of this process use one thread: a task has a core, and the library's other threads would burn theirs waiting."""
    import ctypes

    try:
        with open("/proc/self/maps") as f:
            paths = {line.split()[-1] for line in f if "openblas" in line}
        for lib in map(ctypes.CDLL, paths):
            for name in ("openblas_set_num_threads", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "scipy_openblas_set_num_threads64_"):
                if hasattr(lib, name):
                    getattr(lib, name)(1)
    except OSError:  # no such file system: as many threads as there are
        pass


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers lo..hi of each pair, one range after another."""
    n = (hi - lo).astype(np.int64)
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def _common(size: np.ndarray, entries: int) -> np.ndarray:
    """Which terms so many of a block's entries have that they can be laid out."""
    return size * DENSE > entries


class Index:
    """Block-max inverted index of a model's entries.

    A block is a cluster of entries.  Of each term in each block the postings and the largest weight are known.
    """

    def __init__(self, model: Model, block: int | None = None):
        n, v = len(model.ids), len(model.vocabulary)
        # no reference to the model, which holds this index: both go when the model does
        self.n, self.copies, self.bounds, self.index, self.weight = n, model.n, model.bounds, model.index, model.weights()
        cuts = np.append(np.arange(0, n, block), n) if block else model.cuts if model.cuts is not None else np.unique([0, n])
        #: Where each block begins, and the last ends.
        self.cuts = np.asarray(cuts, dtype=np.int64)
        blocks = len(self.cuts) - 1
        #: Of each term: its largest weight in each block (the bits of floats), where its postings in each begin, and where the last ones end.  A row, so
        #: that what a query asks of a term lies together.
        self.of_term = np.zeros((v, 2 * blocks + 1), dtype=np.int32)
        best, edges = self.of_term.view(np.float32)[:, :blocks], self.of_term[:, blocks:]
        spans = list(zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True))
        for b, (lo, hi) in enumerate(spans):
            edges[:, b + 1] = np.bincount(self._block(lo, hi)[0], minlength=v)
        edges[:, 0] = edges[:, 1:].sum(axis=1, dtype=np.int32)  # a term's postings together, block after block
        edges[:, 0] = np.cumsum(edges[:, 0], dtype=np.int32) - edges[:, 0]
        np.cumsum(edges, axis=1, dtype=np.int32, out=edges)
        #: Postings: the row, and the weight in steps of STEP, as memory is what a search waits for.
        self.postings = np.zeros(len(self.index), dtype=np.uint32 if n <= 1 << 16 else np.uint64)
        kind, filled = self.postings.dtype.type, edges[:, 0].copy()
        for b, (first, last) in enumerate(spans):
            for lo in range(first, last, LAID):  # a few at a time, as workers are small
                index, w, row = self._block(lo, min(lo + LAID, last))
                order = np.argsort(index, kind="stable")
                index, w = index[order], w[order]
                head = np.flatnonzero(np.append(True, index[1:] != index[:-1])) if len(index) else order
                own, size = index[head], np.diff(head, append=len(index))
                if len(own):
                    best[own, b] = np.maximum(best[own, b], np.maximum.reduceat(w, head))
                self.postings[_ranges(filled[own].astype(np.int64), filled[own] + size)] = (row[order].astype(kind) << kind(16)) | np.rint(w / STEP).astype(kind)
                filled[own] += size.astype(np.int32)
        del filled
        self.exact, self.slot = np.zeros(v), np.zeros(v, dtype=np.int32)
        #: Blocks there were and blocks whose postings were read, over all searches.
        self.blocks = self.read = 0

    def _block(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms, weights and rows of entries lo..hi."""
        own = slice(int(self.bounds[lo]), int(self.bounds[hi]))
        return self.index[own], self.weight[own], np.repeat(np.arange(lo, hi, dtype=np.int32), np.diff(self.bounds[lo : hi + 1]))

    @property
    def columns(self) -> list[np.ndarray]:
        """The terms that can be laid out, of each block."""
        size = np.diff(self.of_term[:, len(self.cuts) - 1 :], axis=1)
        return [np.flatnonzero(_common(size[:, b], n)) for b, n in enumerate(np.diff(self.cuts).tolist())]

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int = K, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`search` for one query."""
        return self.search([(term, weight, skip)], k)[0]

    def search(self, queries: list[tuple[np.ndarray, np.ndarray, int]], k: int = K) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, weights, entry to skip or -1): the entries of the k nearest examples, by positive cosine, and all as near as the last of them; and the cosines.

        An entry counts as many as it has examples, the skipped one less.
        """
        if not self.n:
            return [(np.zeros(0, dtype=np.int64), np.zeros(0))] * len(queries)
        blocks = len(self.cuts) - 1
        bound = np.zeros((len(queries), blocks))
        for q, (term, weight, _) in enumerate(queries):
            bound[q] = weight.astype(np.float32) @ self.of_term.take(term, axis=0).view(np.float32)[:, :blocks]
        found: list = [None] * len(queries)
        order = np.argsort(bound.argmax(axis=1), kind="stable")
        for a in range(0, len(queries), ROWS):  # alike ones together
            own = order[a : a + ROWS]
            for q, near in zip(own.tolist(), self._together([queries[q] for q in own.tolist()], bound[own], k), strict=True):
                found[q] = near
        return found

    def _together(self, queries: list, bound: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """:meth:`search` for a few queries, whose bounds in each block are known."""
        rows, blocks = bound.shape
        asked = _Asked(self, queries)
        scores = np.zeros((rows, self.n), dtype=np.float32)
        # how far a query's sums may be off: weights of postings are rounded
        off = np.array([ROUNDING + STEP / 2 * float(np.abs(weight).sum()) for _, weight, _ in queries])
        self.blocks += blocks * rows
        least, head = np.zeros(rows), bound.argmax(axis=1)
        wave = np.zeros((rows, blocks), dtype=bool)
        wave[np.arange(rows), head] = bound[np.arange(rows), head] > 0
        for second in (False, True):
            if second:
                wave = (bound > 0) & (bound + off[:, None] >= least[:, None]) & ~wave
            laid = self._columns(asked, wave, scores)
            if second:  # what the columns gave is known now
                top = np.maximum.reduceat(scores, self.cuts[:-1], axis=1)
                drop = wave & (top + asked.bounds(laid) + 2 * off[:, None] < least[:, None])
                for q, b in zip(*(x.tolist() for x in np.nonzero(drop)), strict=True):
                    scores[q, self.cuts[b] : self.cuts[b + 1]] = 0.0
                wave &= ~drop
            self.read += int(wave.sum())
            self._postings(asked, wave, laid, scores)
            for q in np.flatnonzero(wave.any(axis=1)).tolist():
                skip = queries[q][2]
                if skip >= 0 and self.copies[skip] < 2:
                    scores[q, skip] = 0.0
                own = scores[q] if second else scores[q, self.cuts[head[q]] : self.cuts[head[q] + 1]]
                above = own[own > least[q]]
                if len(above) >= k:
                    least[q] = np.partition(above, -k)[-k]
        return [self._judged(scores[q], least[q] - 2 * off[q], *queries[q], k) for q in range(rows)]

    def _columns(self, asked: _Asked, wave: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Lays out the terms of each block for which a matrix product costs less than postings, and adds the products to the scores of the queries that read the block; whether a term is laid out."""
        laid = np.zeros(asked.size.shape, dtype=bool)
        place = self.postings.dtype.type(16)
        for b in range(wave.shape[1]):
            own = np.flatnonzero(wave[:, b])
            if not len(own):
                continue
            lo, hi = int(self.cuts[b]), int(self.cuts[b + 1])
            mine = wave[:, b][asked.query]
            hits = np.bincount(asked.code[mine], minlength=len(laid))
            laid[:, b] = _common(asked.size[:, b], hi - lo) & ((hits - 1) * asked.size[:, b] * CELLS > (len(own) + LAYOUT) * (hi - lo))
            columns, many = np.flatnonzero(laid[:, b]), max(1, MATRIX // (hi - lo))
            slot = np.zeros(len(wave), dtype=np.int64)
            slot[own] = np.arange(len(own))
            into = slice(own[0], own[-1] + 1) if own[-1] - own[0] < len(own) else own
            for a in range(0, len(columns), many):
                part = columns[a : a + many]
                column = np.full(len(laid), -1)
                column[part] = np.arange(len(part))
                at = column.take(asked.code)
                some = np.flatnonzero(mine & (at >= 0))
                put = np.zeros((len(own), len(part)), dtype=np.float32)
                put[slot.take(asked.query.take(some)), at.take(some)] = asked.weight.take(some)
                begin, end = asked.edges[part, b], asked.edges[part, b + 1]
                found = self.postings.take(_ranges(begin, end), mode="clip")
                dense = np.zeros(len(part) * (hi - lo), dtype=np.float32)
                dense[np.repeat(np.arange(len(part)) * (hi - lo) - lo, end - begin) + (found >> place).astype(np.intp)] = (found & found.dtype.type(0xFFFF)).astype(np.float32) * np.float32(STEP)
                scores[into, lo:hi] += put @ dense.reshape(len(part), hi - lo)
        return laid

    def _postings(self, asked: _Asked, wave: np.ndarray, laid: np.ndarray, scores: np.ndarray) -> None:
        """Adds the postings of the queries' terms that aren't laid out, in the blocks each reads, times their weights, to its scores; a term's in blocks side by side are one range."""
        blocks = wave.shape[1]
        grid = np.zeros((len(asked.code), blocks + 2), dtype=bool)
        np.greater(wave[asked.query], laid[asked.code], out=grid[:, 1:-1])
        turn = np.flatnonzero(grid[:, 1:] != grid[:, :-1])
        of = turn[::2] // (blocks + 1)
        base = asked.code.take(of) * (blocks + 1) - of * (blocks + 1)
        begin, end = (asked.edges.ravel().take(base + turn[side::2]).astype(np.int64) for side in (0, 1))
        some = np.flatnonzero(end > begin)
        of, begin, size = of[some], begin[some], (end - begin)[some]
        weight = asked.weight.take(of) * STEP
        first = np.searchsorted(asked.query.take(of), np.arange(len(wave) + 1))
        upto = np.concatenate([[0], np.cumsum(size)])
        place, mask = self.postings.dtype.type(16), self.postings.dtype.type(0xFFFF)
        # in parts that a core's cache holds
        parts = np.unique(np.concatenate([first, np.searchsorted(upto, np.arange(0, upto[-1], PART))]))
        shift, query, steps = begin - upto[:-1], np.searchsorted(first, parts, "right") - 1, np.arange(PART + max(size.max(initial=0), 1))
        total, spans = np.zeros(self.n), [(int(self.cuts[x.argmax()]), int(self.cuts[blocks - x[::-1].argmax()])) for x in wave]
        for a, b, q, after in zip(parts[:-1].tolist(), parts[1:].tolist(), query[:-1].tolist(), query[1:].tolist(), strict=True):
            at = np.repeat(shift[a:b] + upto[a], size[a:b])  # the places of all ranges
            at += steps[: len(at)]
            found = self.postings.take(at, mode="clip")
            x = np.repeat(weight[a:b], size[a:b])  # doubles, as they are summed
            x *= (found & mask).astype(np.float64)
            np.add.at(total, (found >> place).astype(np.intp), x)
            if after != q:
                lo, hi = spans[q]
                scores[q, lo:hi] += total[lo:hi]
                total[lo:hi] = 0.0

    def _judged(self, score: np.ndarray, least: float, term: np.ndarray, weight: np.ndarray, skip: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.flatnonzero(score >= least if least > 0 else score > 0)
        self.exact[term] = weight
        cosines = self._cosines(rows)
        self.exact[term] = 0.0
        order = np.argsort(-cosines, kind="stable")
        rows, cosines = rows[order], np.minimum(cosines[order], 1.0)
        many = np.cumsum(self.copies[rows] - (rows == skip))
        last = int(np.searchsorted(many, k))
        if last < len(rows):
            keep = cosines >= cosines[last] - 1e-9
            rows, cosines = rows[keep], cosines[keep]
        return rows, cosines

    def _cosines(self, rows: np.ndarray) -> np.ndarray:
        """Exact cosines of entries with the query that is laid out in ``exact``."""
        found = np.empty(len(rows))
        for i, (lo, hi) in enumerate(zip(self.bounds[rows].tolist(), self.bounds[rows + 1].tolist(), strict=True)):
            found[i] = np.dot(self.exact.take(self.index[lo:hi]), self.weight[lo:hi])
        return found


class _Asked:
    """The terms of queries that are searched together: which query's, which of the distinct ones, its weight; and what an index knows of the distinct ones."""

    def __init__(self, index: Index, queries: list):
        blocks = len(index.cuts) - 1
        self.rows, self.query = len(queries), np.repeat(np.arange(len(queries)), [len(term) for term, _, _ in queries])
        term = np.concatenate([term for term, _, _ in queries])
        index.slot[term] = 1
        own = np.flatnonzero(index.slot)
        index.slot[own] = np.arange(len(own), dtype=np.int32)
        self.code = index.slot.take(term).astype(np.int64)
        index.slot[own] = 0
        self.weight = np.concatenate([weight for _, weight, _ in queries]).astype(np.float64)
        known = index.of_term.take(own, axis=0)
        self.best, self.edges = known.view(np.float32)[:, :blocks], np.ascontiguousarray(known[:, blocks:])
        self.size = np.diff(self.edges, axis=1).astype(np.int64)

    def bounds(self, laid: np.ndarray) -> np.ndarray:
        """What the terms that aren't laid out can add to a cosine, of each query in each block."""
        rest = np.where(laid, 0, self.best)
        return np.stack([np.bincount(self.query, self.weight * rest[:, b].take(self.code), self.rows) for b in range(rest.shape[1])], axis=1)


def _weights(count: np.ndarray, term: np.ndarray, row: np.ndarray, model: Model, rows: int) -> np.ndarray:
    seen = term < len(model.vocabulary)
    w = (1 + np.log(count)) * np.where(seen, model.idf[np.where(seen, term, 0)] if len(model.idf) else model.unseen, model.unseen)
    norm = np.sqrt(np.bincount(row, w * w, rows))
    return w / np.where(norm > 0, norm, 1)[row]


def vote(n: np.ndarray, pos: np.ndarray, cosines: np.ndarray, base: float, k: int = K) -> float:
    """The log-odds of the positive share of the votes of ``n`` examples a row, ``pos`` of them positive, nearest first.

    The k nearest vote; of those as near as the k-th (within rounding) each has the same share of the places left.
    """
    many = np.cumsum(n)
    w = cosines**2
    if len(many) and many[-1] > k:
        tied = cosines <= cosines[min(int(np.searchsorted(many, k)), len(many) - 1)] + 1e-9
        w = np.where(tied, w * (k - n[~tied].sum()) / n[tied].sum(), w)
    p = ((w * pos).sum() + PRIOR * base) / ((w * n).sum() + PRIOR)
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def _calibrate(x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> tuple[float, float]:
    """Slope (0.5 to 3) and shift of the logistic curve of y over x, the most likely pair within these bounds.

    Targets are smoothed by the classes' sizes, the slope is drawn to 1 and the shift to 0.  The loss is convex, and a Newton step is halved until it lowers it; a slope
    at a bound stays there while the shift is fitted to it.
    """
    times = np.ones(len(y)) if times is None else times
    n1, n0 = (times * y).sum(), (times * (1 - y)).sum()
    if not n1 or not n0:
        return 1.0, 0.0
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(a: float, b: float) -> float:
        z = a * x + b
        return float((times * (np.logaddexp(0, z) - t * z)).sum() + (a - 1) ** 2 / 2 + b * b / 2)

    a, b = 1.0, 0.0
    for free in (True, False):  # both, then the shift alone
        for _ in range(100):
            p = 0.5 * (1 + np.tanh((a * x + b) / 2))
            miss, w = times * (p - t), times * p * (1 - p)
            g = np.array([(miss * x).sum() + a - 1, miss.sum() + b])
            h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1]])
            step = np.linalg.solve(h, g) if free else np.array([0.0, g[1] / h[1, 1]])
            size, now = 1.0, loss(a, b)
            while size > 1e-10 and loss(a - size * step[0], b - size * step[1]) > now:
                size /= 2
            if size <= 1e-10 or abs(size * step).max() < 1e-9:
                break
            a, b = a - size * step[0], b - size * step[1]
        if 0.5 <= a <= 3:
            break
        a = min(max(a, 0.5), 3.0)
    return float(a), float(b)


def _order(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Entries by clusters, and where blocks begin, the of their vectors over the commonest terms (spherical k-means), so that a block's entries are alike and its bounds tight."""
    n = len(model.ids)
    common = np.argsort(-np.bincount(model.index, minlength=len(model.vocabulary)), kind="stable")[:CLUSTER_TERMS]
    column = np.full(len(model.vocabulary), -1, dtype=np.int32)
    column[common] = np.arange(len(common))
    x, weight = np.zeros((n, len(common)), dtype=np.float32), model.weights()
    for lo in range(0, n, 1024):
        part = slice(model.bounds[lo], model.bounds[min(lo + 1024, n)])
        row = np.repeat(np.arange(lo, min(lo + 1024, n)), np.diff(model.bounds[lo : lo + 1025]))
        own = column[model.index[part]]
        x[row[own >= 0], own[own >= 0]] = weight[part][own >= 0]
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)
    centre = x[np.linspace(0, n - 1, min(CLUSTERS, n)).astype(int)]
    for _ in range(ROUNDS):
        own = (x @ centre.T).argmax(axis=1)
        centre = np.stack([x[own == c].sum(axis=0) if (own == c).any() else centre[c] for c in range(len(centre))])
        centre /= np.maximum(np.sqrt((centre * centre).sum(axis=1, keepdims=True)), 1e-9)
    near = x @ centre.T
    own = near.argmax(axis=1)
    order = np.lexsort((model.ids, -near[np.arange(n), own], own))
    size = np.bincount(own, minlength=len(centre))
    begin = np.cumsum(size) - size
    cuts = np.concatenate([np.arange(a, a + m, BLOCK) for a, m in zip(begin, size, strict=True)])
    return order, np.append(cuts, n)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most ``sample`` labelled documents (see :func:`weft.llm.lines.labelled_sample`); IDF covers all documents.

    Sampled documents without any word have no vector; their rate of positives
    is the score of documents without any.
    """
    tx.bounded_batches(docs.sparkSession)
    picked = ln.labelled_sample(docs, labels, label_col, sample, id_col, text_col)
    texts = picked.groupBy(F.coalesce("_text", F.lit("")).alias("text")).agg(F.min("_id").cast("bigint").alias("id"), F.count(F.lit(1)).alias("n"), F.sum("_label").cast("bigint").alias("pos"))
    vocabulary, scale, place = _vocabulary(texts)
    df, n_docs = _document_counts(docs, text_col, vocabulary)
    idf = (np.log(1 + n_docs) + 1 - np.log1p(df)).astype(np.float32) * scale.astype(np.float32)
    idf[place] = idf.copy()
    unseen = float((np.log(1 + n_docs) + 1 - np.log(2.0)) * (FLOOR if scale.min(initial=1.0) < 1 else 1.0))
    schema = T.StructType.fromDDL("id bigint, n bigint, pos bigint, term array<int>, count array<int>")

    def run(batches):
        for b in batches:
            for part in tx.runs(b.column(0)):
                row, term, count = _counted(part, vocabulary, place)
                upto = np.searchsorted(row, np.arange(part.rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(upto), pa.array(x.astype(np.int32))) for x in (term, count)]
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(part.lo, part.rows) for k in (1, 2, 3)), *lists], names=schema.names)

    rows = texts.select("text", "id", "n", "pos").mapInArrow(run, schema).toArrow()
    ids, n, pos = (rows[c].to_numpy() for c in ("id", "n", "pos"))
    size = pc.list_value_length(rows["term"]).to_numpy().astype(np.int64)
    term, count = (pc.list_flatten(rows[c]).to_numpy() for c in ("term", "count"))
    del rows
    blank = size == 0
    blank_rate = float((pos[blank].sum() + 0.5) / (n[blank].sum() + 2)) if len(n) else 0.0
    ids, n, pos, size = (x[~blank] for x in (ids, n, pos, size))
    base = float(pos.sum() / n.sum()) if len(n) else 0.0
    model = Model(vocabulary, place, idf, unseen, ids, n, pos, np.concatenate([[0], np.cumsum(size)]), term, count, base_rate=base, blank_rate=blank_rate)
    if not len(ids):
        return model
    order, model.cuts = _order(model)
    model.weight = None
    spans = [slice(a, b) for a, b in zip(model.bounds[order].tolist(), model.bounds[order + 1].tolist(), strict=True)]
    model.index = np.concatenate([term[x] for x in spans])
    del term
    model.count = np.concatenate([count[x] for x in spans])
    del count
    model.ids, model.n, model.pos, model.bounds = ids[order], n[order], pos[order], np.concatenate([[0], np.cumsum(size[order])])
    x, y, times = _left_out(docs.sparkSession, model)
    model.slope, model.shift = _calibrate(x, y, times)
    return model


def _left_out(spark: SparkSession, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds of the examples by the votes of all others, their labels, and how many examples of an entry have that label."""
    # sent once: the tasks that score use it too, with the index that their workers have made
    held, n = spark.sparkContext.broadcast(model), len(model.ids)
    model.sent = held

    def run(batches):
        own = held.value
        index = own.searched()
        for b in batches:
            for a in b.column(0).to_pylist():
                out, rows_of = [], range(a, min(a + ROWS, n))
                spans = [slice(own.bounds[i], own.bounds[i + 1]) for i in rows_of]
                for i, (rows, c) in zip(rows_of, index.search([(own.index[x], own.weights()[x], i) for i, x in zip(rows_of, spans, strict=True)]), strict=True):
                    for label, times in ((1, own.pos[i]), (0, own.n[i] - own.pos[i])):
                        if times:
                            me = rows == i
                            out.append((vote(own.n[rows] - me, own.pos[rows] - me * label, c, own.base_rate), label, int(times)))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.float64(), pa.int64(), pa.int64()))], names=["odds", "label", "times"])
        tx.give_back()

    tasks = max(1, min(-(-n // 1024), spark.sparkContext.defaultParallelism))
    got = spark.range(0, n, ROWS, tasks).mapInArrow(run, "odds double, label bigint, times bigint").toArrow()  # two rows an entry at most
    return got["odds"].to_numpy(), got["label"].to_numpy(), got["times"].to_numpy()


def scores(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a struct of their toxicity and its evidence: the nearest labelled examples and their cosines, nearest first.

    Of examples with equal text the evidence names the one with the least id, and it holds K texts at most; all of them vote.
    A document without a word, such as a null or empty one, has no
    neighbours; its score is the rate of positives among such examples.  Equal
    texts get equal scores; every row of the input is in the output once.  A very long text is one vector.
    """
    held = model.__dict__.get("sent") or docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample and its terms
    curve = model.slope, model.shift

    def make():
        own = held.value
        return lambda column: judge(column, own, own.searched(), threshold, curve)

    return tx.annotate(docs, text_col, make, SCORE, out)


def judge(column: pa.Array, model: Model, index: Index, threshold: float, curve: tuple[float, float] = (1.0, 0.0)) -> pa.StructArray:
    known = index.__dict__.setdefault("judged", {})
    if len(known) > REMEMBERED:
        known.clear()
    keys: list[tuple[int, int]] = []
    todo: dict[tuple[int, int], tuple] = {}

    def settle() -> None:
        for key, (at, c) in zip(todo, index.search(list(todo.values())), strict=True):
            score = 0.5 * (1 + np.tanh((curve[0] * vote(model.n[at], model.pos[at], c, model.base_rate) + curve[1]) / 2))
            known[key] = (float(score), model.ids[at[:K]].tolist(), c[:K].tolist())
        todo.clear()

    waiting = 0
    for run in tx.runs(column):
        text = list(zip(run.hashes(run.bounds[:-1], run.bounds[1:]).tolist(), np.diff(run.bounds).tolist(), strict=True))
        keys += text
        row, term, count = _counted(run, model.vocabulary, model.place)
        weight = _weights(count, term, row, model, run.rows) if len(row) else np.zeros(0)
        upto = np.searchsorted(row, np.arange(run.rows + 1)).tolist()
        seen = term < len(model.vocabulary)  # other terms are in no example
        for r, key in enumerate(text):
            if key in known or key in todo:
                continue
            if not index.n or upto[r] == upto[r + 1]:
                known[key] = (model.blank_rate, [], [])
                continue
            x = np.flatnonzero(seen[upto[r] : upto[r + 1]]) + upto[r]
            todo[key] = (term[x], weight[x], -1)
            waiting += len(x)
        if waiting > WAITING:
            settle()
            waiting = 0
    if todo:
        settle()
    found = [known[key] for key in keys]
    score = np.array([f[0] for f in found])
    return tx.struct(score=score, predicted=(score >= threshold).astype(np.int32), neighbours=pa.array([f[1] for f in found], type=pa.list_(pa.int64())), cosines=pa.array([f[2] for f in found], type=pa.list_(pa.float64())))
