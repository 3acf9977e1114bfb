"""Language identification by nearest centroids of TF-IDF n-gram vectors (operator 4).

A vector counts the byte trigrams of the whole text (A-Z lower-cased, every
other ASCII byte that isn't a letter a space) in DIMENSIONS hashed places, weighs them by
(1 + ln tf) times an IDF over all training documents, and has length 1.  Each
language has up to CLUSTERS centroids, found by spherical k-means over a bounded sample
of its training documents, one task a language.  A document takes the language
of the centroid of largest cosine.  It is rejected where that cosine is far
below what the sample has at the document's length, or at the lengths nearest to it
that the sample has enough texts of.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm import lines as ln
from weft.llm import text as tx

#: Places of a vector, centroids of a language, and training documents a language that centroids are fitted to, at most.
DIMENSIONS, CLUSTERS, SAMPLE = 8192, 4, 400
#: A document is rejected below this part of the cosine that all but one in a hundred of the sample reach.
REJECT = 0.4
#: Texts of the sample that a threshold needs, at least; lengths that have fewer borrow from their neighbours.
BACKED = 20
#: Rows whose vectors are held at once.
ROWS = 256

LANG = "lang string, score double, rejected boolean"
_ARROW = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

_CLASS = np.arange(256)
_CLASS[0x41:0x5B] += 32
_CLASS[:128][~np.isin(np.arange(128), [*range(0x41, 0x5B), *range(0x61, 0x7B)])] = 0x20
_CLASS = _CLASS.astype(np.uint32)
_LETTER = np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B)])
#: Parts of a language whose ids are ranked apart.
SALTS = 16


def vectors(run: tx.Run, idf: np.ndarray | None):
    """For some rows at a time: their range, and their weighted vectors of length 1 (without idf: whether they have each place)."""
    code = _CLASS[run.data]
    if len(code) > 2:
        gram = ((code[:-2] << np.uint32(16)) | (code[1:-1] << np.uint32(8)) | code[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)
    else:
        gram = np.zeros(0, dtype=np.uint32)
    for lo in range(0, run.rows, ROWS):
        hi = min(lo + ROWS, run.rows)
        a, b = run.bounds[lo], max(run.bounds[hi] - 2, run.bounds[lo])
        size = np.diff(run.bounds[lo : hi + 1])
        row = np.repeat(np.arange(hi - lo), size)[: b - a]
        inside = np.arange(a, b) + 2 < run.bounds[lo + 1 : hi + 1][row]  # the trigram ends in the row
        count = np.bincount(row[inside] * DIMENSIONS + gram[a:b][inside], minlength=(hi - lo) * DIMENSIONS)
        some = np.flatnonzero(count)
        if idf is None:
            yield lo, hi, np.bincount(some % DIMENSIONS, minlength=DIMENSIONS)
            continue
        out = np.zeros((hi - lo) * DIMENSIONS, dtype=np.float32)
        out[some] = (1 + np.log(count[some])) * idf[some % DIMENSIONS]
        out = out.reshape(hi - lo, DIMENSIONS)
        norm = np.sqrt(np.einsum("ij,ij->i", out, out))
        yield lo, hi, out / np.where(norm > 0, norm, 1)[:, None]


def has_letter(run: tx.Run) -> np.ndarray:
    """Whether each row has a letter (Unicode category L)."""
    some = run.count(_LETTER, run.bounds) > 0
    for r in np.flatnonzero(~some & (np.diff(run.bounds) > 0)).tolist():
        some[r] = any(c.isalpha() for c in run.data[run.bounds[r] : run.bounds[r + 1]].tobytes().decode("utf-8", "replace"))
    return some


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str]
    #: Language and vector of each centroid; least cosine by the doublings of a text's bytes.
    lang: np.ndarray
    centroids: np.ndarray
    least: np.ndarray


def _bin(size: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(size, 1)).astype(np.int64), 31)


def _least(size: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    """The least cosine by the doublings of a text's bytes: of the sample's texts of that many, and of the next ones up to BACKED in all."""
    size, cosine = size[cosine > 0], cosine[cosine > 0]  # no likeness at all is always below
    bins, least = _bin(size), np.zeros(32)
    for k in range(32 if len(size) else 0):
        away = np.abs(bins - k)
        reach = np.sort(away)[min(BACKED, len(away)) - 1]  # 0 where the length itself has enough
        least[k] = REJECT * np.quantile(cosine[away <= reach], 0.01)
    return least


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of length 1 by spherical k-means, begun with rows far from each other."""
    seeds = [int((x @ x.sum(axis=0)).argmax())]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        c = np.stack([x[at == j].sum(axis=0) if (at == j).any() else c[j] for j in range(len(c))])
        c = c / np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-12)
    return c


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", among: Callable | None = None, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model:
    """A model from the documents with a language whose id's fold by 3 isn't 1 (``among``: another condition on the id).

    IDF counts all of them; centroids are fitted to at most ``sample`` pairs of id and text a
    language, those whose ids hash lowest; a pair that several rows repeat is one.  Without any the model knows no
    language.
    """
    tx.bounded_batches(docs.sparkSession)
    ident, text, lang = (F.col(f"`{c}`") for c in (id_col, text_col, lang_col))
    among = among or (lambda i: ln.fold(i, 3) != 1)
    own = docs.select(ident.alias("i"), text.alias("t"), lang.cast("string").alias("l")).where(among(F.col("i")) & F.col("l").isNotNull() & F.col("t").isNotNull())

    def count(batches):
        tx.let_go()  # a toxicity model and its index, say
        total, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for b in batches:
            n += b.num_rows
            for run in tx.runs(b.column(0)):
                for _, _, have in vectors(run, None):
                    total += have
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS, dtype=np.int32)), pa.array(np.append(n, total))], names=["place", "df"])

    df = np.zeros(DIMENSIONS + 1)
    for r in own.select("t").mapInArrow(count, "place int, df bigint").groupBy("place").agg(F.sum("df").alias("df")).collect():  # one row per place
        df[r.place + 1] = r.df
    idf = (np.log((1 + df[0]) / (1 + df[1:])) + 1).astype(np.float32)
    # each task keeps at most that many ids of a language and salt before the shuffle, and a language's salts are ranked apart,
    # so neither the number of tasks nor an id that many rows share makes what one task ranks grow
    narrow = own.select("l", "i", F.xxhash64("t").alias("h"))
    order = [F.xxhash64("i"), F.col("i"), F.col("h")]
    salted = Window.partitionBy("l", F.pmod(F.xxhash64("i", "h"), F.lit(SALTS))).orderBy(*order)
    first = narrow.withColumn("r", F.dense_rank().over(salted)).where(F.col("r") <= sample).select("l", "i", "h").distinct()
    chosen = first.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(*order))).where(F.col("r") <= sample).drop("r")
    few = own.withColumn("h", F.xxhash64("t")).join(F.broadcast(chosen), ["l", "i", "h"]).dropDuplicates(["l", "i", "h"]).select("l", "i", "t")
    schema = T.StructType.fromDDL("l string, c array<array<float>>, size array<bigint>, cosine array<double>")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i", kind="stable")
        parts, sizes = [], []
        for run in tx.runs(pa.array(group["t"], type=pa.string())):
            letters = has_letter(run)
            for lo, hi, x in vectors(run, idf):
                parts.append(x[letters[lo:hi]])
            sizes.append(np.diff(run.bounds)[letters])
        x, size = np.concatenate(parts), np.concatenate(sizes)
        if not len(x):
            return pd.DataFrame({"l": [], "c": [], "size": [], "cosine": []})
        c = _cluster(x, clusters)
        return pd.DataFrame({"l": [group["l"].iloc[0]], "c": [[v.tolist() for v in c]], "size": [size.tolist()], "cosine": [(x @ c.T).max(axis=1).astype(float).tolist()]})

    found = sorted(few.groupBy("l").applyInPandas(fit, schema).collect(), key=lambda r: r.l)  # a row per language
    least = _least(*(np.concatenate([np.zeros(0), *(r[c] for r in found)]) for c in ("size", "cosine")))
    langs = [r.l for r in found]
    return Model(idf, langs, np.repeat(np.arange(len(found)), [len(r.c) for r in found]), np.array([v for r in found for v in r.c], dtype=np.float32).reshape(-1, DIMENSIONS), least)


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """The documents with a struct: ``lang``, the cosine ``score`` and whether it is ``rejected``.

    Texts that are null or have no letter are ``und`` with score 0, and
    rejected; so is everything where the model knows no language.  Ties go to
    the language that sorts first.  Every row of the input is in the output once.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded: CLUSTERS centroids a language

    def make():
        own = held.value
        return lambda column: tx.joined([judge(run, own) for run in tx.runs(column)], _ARROW)

    return tx.annotate(docs, text_col, make, LANG, out)


def judge(run: tx.Run, model: Model) -> pa.StructArray:
    score, best = np.zeros(run.rows), np.zeros(run.rows, dtype=np.int64)
    known = has_letter(run) & bool(model.langs)
    if model.langs:
        for lo, hi, x in vectors(run, model.idf):
            like = x @ model.centroids.T
            best[lo:hi] = model.lang[like.argmax(axis=1)]
            score[lo:hi] = like.max(axis=1)
    score = np.where(known, np.clip(score, 0, 1), 0.0)
    names = np.array([*model.langs, "und"], dtype=object)
    lang = names[np.where(known, best, len(model.langs))]
    return tx.struct(lang=pa.array(lang, type=pa.string()), score=score, rejected=~known | (score < model.least[_bin(np.diff(run.bounds))]))
