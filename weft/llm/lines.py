"""Line features and linear-chain conditional random fields over the lines of a document.

A line is a ``\n``-split piece with at least one word ``[^\x20\x09-\x0D]+``;
pieces without a word are skipped, so a null, empty or blank text has no lines.
The field has two labels, 1 for good (content) lines and 0 for bad ones: an
emission weight vector over the features of a line and its two neighbours, and
start and transition scores.  Sequences are worked on together, one step of
all documents at a time, in memory proportional to the number of lines.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import text as tx

#: Characters of ``[#*$%&|<>]``.
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
_UPPER = np.isin(np.arange(256), np.arange(0x41, 0x5B))
_DIGIT = np.isin(np.arange(256), np.arange(0x30, 0x3A))
_BANG = np.arange(256) == 0x21
_PIPE = np.arange(256) == 0x7C
_STOP = np.isin(np.arange(256), np.frombuffer(b".?!:;", dtype=np.uint8))

OWN = ("words", "word_length", "symbols", "upper", "digits", "bangs", "pipes", "stop", "repeats", "windows", "copy", "short")
#: Features whose values on the line before and the line after count too.
NEAR = ("symbols", "upper", "bangs", "pipes", "repeats", "windows", "copy")
FEATURES = ("one", *OWN, *(f"before_{x}" for x in NEAR), *(f"after_{x}" for x in NEAR), "only")
#: Where training starts, and what it is drawn to: prose is good, the rest bad.
PRIOR = {"one": 2.0, "symbols": -4.0, "bangs": -4.0, "pipes": -4.0, "repeats": -3.0, "windows": -1.5, "copy": -0.5, "upper": -1.0}


@dataclass
class Field:
    """Weights per feature for label 1 against 0; scores of starting with, and passing between, labels."""

    weights: np.ndarray
    start: np.ndarray
    turn: np.ndarray


def prior() -> Field:
    return Field(np.array([PRIOR.get(x, 0.0) for x in FEATURES]), np.zeros(2), np.array([[0.5, -0.5], [-0.5, 0.5]]))


class Lines:
    """The lines (with a word) of a run, their features, and what the base measures of the documents need."""

    def __init__(self, run: tx.Run):
        starts, ends, words = run.spans(tx.SPACED)
        row = tx.row_of(words)
        line_s, line_e, _ = run.lines()
        self.n_words = np.diff(words)
        # words per line: lines are in order of place, as words are
        at = np.searchsorted(starts, line_s)
        upto = np.searchsorted(starts, line_e)
        keep = np.flatnonzero(upto > at)
        line_s, line_e, at, upto = line_s[keep], line_e[keep], at[keep], upto[keep]
        self.row = np.searchsorted(run.bounds, line_s, "right") - 1
        self.first = np.searchsorted(self.row, np.arange(run.rows + 1))
        self.length = np.maximum(line_e - line_s, 1).astype(float)
        n = (upto - at).astype(float)
        hashes = run.hashes(starts, ends)
        windows, window_row = tx.grams(hashes, words, 3)
        twice, _ = tx.repeated(windows, window_row)
        covered = np.zeros(len(hashes) + 2, dtype=bool)
        # the word at which each window begins: windows are missing where a row has under three words left
        begin = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, dtype=np.int64)
        for k in range(3):
            covered[begin[twice] + k] = True
        covered = covered[: len(hashes)]
        self.n_repeat_words = np.bincount(row[covered], minlength=run.rows)
        _, earlier = tx.repeated(run.hashes(line_s, line_e), self.row)
        self.n_dup_lines = np.bincount(self.row[earlier], minlength=run.rows)
        points = (run.data & 0xC0) != 0x80  # first bytes of characters
        in_word = np.concatenate([[0], np.cumsum(points & tx.SPACED[run.data])])
        self.word_chars = np.diff(in_word[run.bounds])
        self.n_symbols = run.count(SYMBOLS, run.bounds)

        def share(table: np.ndarray) -> np.ndarray:
            places = np.flatnonzero(table[run.data])
            return (np.searchsorted(places, line_e) - np.searchsorted(places, line_s)) / self.length

        def of_words(flag: np.ndarray) -> np.ndarray:
            places = np.flatnonzero(flag)
            return (np.searchsorted(places, upto) - np.searchsorted(places, at)) / n

        again = np.zeros(len(hashes), dtype=bool)
        if len(hashes):
            again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        own = {
            "words": np.log1p(n) / 4,
            "word_length": np.minimum(self.length / n / 8, 4),
            "symbols": np.minimum(8 * share(SYMBOLS), 2),
            "upper": np.minimum(2 * share(_UPPER), 2),
            "digits": np.minimum(4 * share(_DIGIT), 2),
            "bangs": np.minimum(8 * share(_BANG), 2),
            "pipes": np.minimum(8 * share(_PIPE), 2),
            "stop": _STOP[run.data[line_e - 1]].astype(float) if len(line_e) else np.zeros(0),
            "repeats": of_words(again),
            "windows": of_words(covered),
            "copy": earlier.astype(float),
            "short": (n < 4).astype(float),
        }
        begins, finishes = np.ones(len(n), dtype=bool), np.ones(len(n), dtype=bool)
        if len(n):
            begins[1:] = self.row[1:] != self.row[:-1]
            finishes[:-1] = begins[1:]
        cols = [np.ones(len(n)), *(own[x] for x in OWN)]
        for x in NEAR:
            before = np.zeros(len(n))
            before[1:] = own[x][:-1]
            cols.append(np.where(begins, 0, before))
        for x in NEAR:
            after = np.zeros(len(n))
            after[:-1] = own[x][1:]
            cols.append(np.where(finishes, 0, after))
        cols.append((begins & finishes).astype(float))
        self.features = np.stack(cols, axis=1) if len(n) else np.zeros((0, len(FEATURES)))


def _steps(first: np.ndarray):
    """For t = 0, 1, …: the items that are the t-th of their sequences, longest sequences first."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    for t in range(int(size[0]) if len(size) else 0):
        yield begin[: int(np.searchsorted(-size, -t, "left"))] + t


def viterbi(field: Field, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The most likely labels (ties: 1)."""
    score = np.zeros((len(features), 2))
    score[:, 1] = features @ field.weights
    came = np.zeros((len(features), 2), dtype=np.int8)
    label = np.zeros(len(features), dtype=np.int8)
    steps = list(_steps(first))
    for t, now in enumerate(steps):
        if t == 0:
            score[now] += field.start
            continue
        ways = score[now - 1][:, :, None] + field.turn[None]
        came[now] = ways[:, 1] >= ways[:, 0]
        score[now] += ways.max(axis=1)
    for t in range(len(steps) - 1, -1, -1):
        now = steps[t]
        label[now] = score[now, 1] >= score[now, 0]
        if t + 1 < len(steps):  # sequences that go on are told by their next item
            on = steps[t + 1]
            label[on - 1] = came[on, label[on]]
    return label


def marginals(field: Field, features: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's probability of label 1, and the expected number of each passage between labels."""
    n = len(features)
    emit = np.zeros((n, 2))
    emit[:, 1] = features @ field.weights
    ahead, back = emit.copy(), np.zeros((n, 2))
    steps = list(_steps(first))
    for t, now in enumerate(steps):
        if t == 0:
            ahead[now] += field.start
        else:
            ahead[now] += np.logaddexp(ahead[now - 1][:, :1] + field.turn[0], ahead[now - 1][:, 1:] + field.turn[1])
    for t in range(len(steps) - 1, 0, -1):
        now = steps[t]
        on = emit[now] + back[now]
        back[now - 1] = np.logaddexp(field.turn[:, 0][None] + on[:, :1], field.turn[:, 1][None] + on[:, 1:])
    both = ahead + back
    total = np.logaddexp(both[:, 0], both[:, 1])
    passed = np.zeros((2, 2))
    if len(steps) > 1:
        now = np.concatenate(steps[1:])
        for i in range(2):
            for j in range(2):
                passed[i, j] = np.exp(ahead[now - 1, i] + field.turn[i, j] + emit[now, j] + back[now, j] - total[now]).sum()
    return np.exp(both[:, 1] - total), passed


def train(features: np.ndarray, label: np.ndarray, first: np.ndarray, rounds: int = 80, rate: float = 0.15, pull: float = 1e-3) -> Field:
    """Ascend the conditional likelihood of the labels (Adam), drawn to :func:`prior` by a squared penalty.

    Without lines the result is the prior.
    """
    base = prior()
    k = features.shape[1]
    theta0 = np.concatenate([base.weights, base.start, base.turn.ravel()])
    if not len(label):
        return base
    theta, m, v = theta0.copy(), np.zeros_like(theta0), np.zeros_like(theta0)
    head = first[:-1][np.diff(first) > 0]
    y = label.astype(np.int64)
    rest = np.ones(len(y), dtype=bool)
    rest[head] = False
    at = np.flatnonzero(rest)
    seen_turn = np.zeros((2, 2))
    np.add.at(seen_turn, (y[at - 1], y[at]), 1)
    seen_start = np.bincount(y[head], minlength=2).astype(float)
    for t in range(1, rounds + 1):
        field = Field(theta[:k], theta[k : k + 2], theta[k + 2 :].reshape(2, 2))
        p, passed = marginals(field, features, first)
        start = np.array([(1 - p[head]).sum(), p[head].sum()])
        grad = np.concatenate([features.T @ (y - p), seen_start - start, (seen_turn - passed).ravel()]) / len(y) - pull * (theta - theta0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Field(theta[:k], theta[k : k + 2], theta[k + 2 :].reshape(2, 2))


def fold(doc_id, of: int):
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts and labels of at most ``size`` labelled documents: those whose ids hash lowest.

    Only labels of documents whose :func:`fold` by 5 isn't 0 are read.  An id
    that is labelled more than once counts once, with its largest label.
    """
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), 5) != 0))
        .groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(size)
    )
    # the picked ids are few whatever the tables hold: at most ``size``
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id").dropDuplicates(["_id"])


def line_table(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and weak labels (the document's) of the lines of a bounded sample, and each document's first line."""
    import pyarrow as pa
    from pyspark.sql import types as T

    tx.bounded_batches(sample.sparkSession)
    schema = T.StructType.fromDDL("_id long, line long, label int, f array<float>")

    def run(batches):
        for b in batches:
            ids, labels = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            for part in tx.runs(b.column(1)):
                lines = Lines(part)
                n, k = lines.features.shape
                flat = pa.array(lines.features.astype(np.float32).ravel())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[part.lo + lines.row]), pa.array(np.arange(n)), pa.array(labels[part.lo + lines.row].astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), flat)],
                    names=schema.names,
                )

    got = sample.select("_id", "_text", "_label").mapInArrow(run, schema).toPandas()
    if not len(got):
        return np.zeros((0, len(FEATURES))), np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)
    got = got.sort_values(["_id", "line"], kind="stable")
    ids = got["_id"].to_numpy()
    first = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])
    return np.stack(got["f"].to_numpy()).astype(float), got["label"].to_numpy(), first
