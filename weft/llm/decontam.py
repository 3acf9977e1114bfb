"""Benchmark decontamination with a generalised suffix automaton of the items (operator 8)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm import automaton as sa
from weft.llm import text as tx
from weft.session import materialize

#: Words of a window; an item with fewer words is one window.
WINDOW = 10
#: Words of benchmark items in one automaton, about.  More items take more passes over the documents.
SHARD_WORDS = 200_000
#: Largest share of its words that a document may have in benchmark windows and stay (without them).
COVERAGE = 0.5

_HITS = "n_words bigint, words array<struct<a:bigint,b:bigint>>, bytes array<struct<a:bigint,b:bigint>>, items array<bigint>"
_SPAN = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_HITS_ARROW = pa.struct([("n_words", pa.int64()), ("words", _SPAN), ("bytes", _SPAN), ("items", pa.list_(pa.int64()))])


class Windows:
    """The automaton of a bounded shard of items, and the windows' items."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        phrases = [sa.phrase(t) for _, t in items]
        self.ids, self.window = [i for i, _ in items], window
        self.auto = sa.Automaton(phrases)
        self.short = [0 < len(p) < window for p in phrases]
        self.size = [len(p) for p in phrases]
        self.least = min([window, *(n for n in self.size if n)])
        self.reduced, self.held = self.auto.at_length(window), self.auto.holders(window)

    def scan(self, run: tx.Run) -> pa.StructArray:
        starts, ends, hashes, first = sa.words(run)
        row = tx.row_of(first)
        numbers = self.auto.numbers(hashes)
        hit = np.zeros(len(hashes) + 1, dtype=np.int64)  # changes of how many windows a word is in
        items: dict[int, set[int]] = {}
        suffixes, reduced, held, window = self.auto.suffixes, self.reduced, self.held, self.window
        for lo, hi in self.auto.stretches(numbers, row, self.least):
            found: set[int] = set()
            for i, (size, state) in enumerate(self.auto.statistics(numbers[lo:hi].tolist()), lo):
                if size >= window:
                    hit[i - window + 1] += 1
                    hit[i + 1] -= 1
                    found |= held[reduced[state]]
                for k in suffixes[state]:
                    if self.short[k] and self.size[k] <= size:
                        hit[i - self.size[k] + 1] += 1
                        hit[i + 1] -= 1
                        found.add(k)
            if found:
                items.setdefault(int(row[lo]), set()).update(self.ids[k] for k in found if self.ids[k] is not None)
        inside = np.cumsum(hit)[:-1] > 0
        # spans of hit words within a row
        joined = inside.copy()
        if len(inside):
            joined[1:] &= inside[:-1] & (row[1:] == row[:-1])
            joined[0] = False
        begin = np.flatnonzero(inside & ~joined)
        end = np.flatnonzero(inside & ~np.append(joined[1:], False))
        upto = np.searchsorted(row[begin], np.arange(run.rows + 1)).astype(np.int32)
        base, at = first[:-1][row[begin]], run.bounds[:-1][row[begin]]
        spans = lambda a, b: pa.ListArray.from_arrays(pa.array(upto), pa.StructArray.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]))
        ids = pa.array([sorted(items.get(r, ())) for r in range(run.rows)], type=pa.list_(pa.int64()))
        return tx.struct(n_words=pa.array(np.diff(first), type=pa.int64()), words=spans(begin - base, end - base + 1), bytes=spans(starts[begin] - at, ends[end] - at), items=ids)


def shards(items: DataFrame, id_col: str = "item_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> list[list[tuple[int | None, str | None]]]:
    """The items in lists of about ``shard_words`` words each, dealt by a hash."""
    tidy = items.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct()
    total = tidy.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, math.ceil(total / 5 / shard_words))
    dealt = tidy.withColumn("k", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    # each shard is bounded, so the driver never holds more than one beside those it has broadcast
    return [[(r.i, r.t) for r in dealt.where(F.col("k") == k).orderBy("i", "t").collect()] for k in range(n)]


def find(docs: DataFrame, items: DataFrame, text_col: str = "text", out: str = "hits", window: int = WINDOW, item_id: str = "item_id", item_text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents with a struct of what they share with the items.

    ``n_words``: words of the text; ``words`` and ``bytes``: the maximal spans
    of words inside occurrences of windows, as half-open ranges of words and of
    UTF-8 bytes; ``items``: distinct ids of items with an occurring window,
    ascending (an item without an id has windows but isn't listed).  A null or
    empty text has no words; items without words, and an empty table of items,
    have no windows.  Repeated items count once.  Every row of the input is in
    the output once.
    """
    spark = docs.sparkSession
    parts = shards(items, item_id, item_text, shard_words)
    columns, names = docs.columns, []
    for k, part in enumerate(parts):
        held = spark.sparkContext.broadcast(part)
        name = tx.free_name([*docs.columns, out], f"_hits{k}")
        names.append(name)

        def make(held=held):
            windows = Windows(held.value, window)
            return lambda column: tx.joined([windows.scan(run) for run in tx.runs(column)], _HITS_ARROW)

        docs = tx.annotate(docs, text_col, make, _HITS, name)
        if len(parts) > 1:
            docs = materialize(docs)  # one automaton at a time
    if len(parts) == 1:
        return docs.withColumnRenamed(names[0], out)
    return _merged(docs, columns, names, out)


def _merged(docs: DataFrame, columns: list[str], names: list[str], out: str) -> DataFrame:
    """One struct from those of several shards: spans united, items together."""
    at = [docs.columns.index(n) for n in names]
    schema = T.StructType([*(docs.schema[docs.columns.index(c)] for c in columns), T.StructField(out, T.StructType.fromDDL(_HITS))])

    def unite(spans):
        found = []
        for s in sorted((x["a"], x["b"]) for x in spans):
            if found and s[0] <= found[-1][1]:
                found[-1][1] = max(found[-1][1], s[1])
            else:
                found.append([*s])
        return [{"a": a, "b": b} for a, b in found]

    def run(batches):
        for b in batches:
            each = [b.column(i).to_pylist() for i in at]
            rows = []
            for hits in zip(*each, strict=True):
                spans = {"words": [], "bytes": []}
                # byte spans go with word spans: unite the words, and take the outer bytes of each
                pairs = sorted((w["a"], w["b"], y["a"], y["b"]) for h in hits for w, y in zip(h["words"], h["bytes"], strict=True))
                for a, z, c, d in pairs:
                    if spans["words"] and a <= spans["words"][-1]["b"]:
                        if z > spans["words"][-1]["b"]:
                            spans["words"][-1]["b"], spans["bytes"][-1]["b"] = z, d
                    else:
                        spans["words"].append({"a": a, "b": z})
                        spans["bytes"].append({"a": c, "b": d})
                rows.append({"n_words": hits[0]["n_words"], **spans, "items": sorted({i for h in hits for i in h["items"]})})
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(columns))), pa.array(rows, type=_HITS_ARROW)], names=schema.names)

    return docs.mapInArrow(run, schema)


def n_hit(hits):
    """The number of hit words, from the struct column of :func:`find`."""
    return F.aggregate(hits["words"], F.lit(0).cast("bigint"), lambda n, s: n + s["b"] - s["a"])


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", coverage: float = COVERAGE, **options) -> DataFrame:
    """The documents without their spans in benchmark windows; those with more than ``coverage`` of their words in them go.

    Columns are as in the input; the text alone changes, and only where it has
    a hit: the bytes from the first to the last word of each span are cut out.
    """
    name = tx.free_name(docs.columns, "_hits")
    found = find(docs, items, text_col, out=name, **options)
    hits = F.col(name)
    kept = found.where(n_hit(hits) <= coverage * hits["n_words"])
    raw = F.col(f"`{text_col}`").cast("binary")
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(hits["bytes"], lambda s: s["b"]))
    starts = F.concat(F.transform(hits["bytes"], lambda s: s["a"]), F.array(F.octet_length(raw).cast("bigint")))
    pieces = F.zip_with(ends, starts, lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string"))
    cut = F.when(F.size(hits["bytes"]) > 0, F.concat_ws("", pieces)).otherwise(F.col(f"`{text_col}`"))
    return kept.withColumn(text_col, cut).drop(name)
