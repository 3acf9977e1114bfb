"""Filter interaction audit: what each filter removes in each order, by min-plus removal ranks (operator 13).

A document's failures are a bit mask, one bit a filter.  Documents with the same
mask, part and labels are counted on Spark, with partial counts before the
shuffle, so what is left of a part is at most 4 x 2**filters counts, however many documents it
has.  A part's removal steps are then the min-plus product of two matrices: masks x filters (0 where the mask
fails the filter, infinity where it passes) and filters x orders (the place of the filter in the order, the inverse of
the permutation): the least sum is the step at which the order removes the mask.  Counts are scattered to those steps.

A null text is empty.  Rows count as often as they are repeated; an empty table gives no row.  Null parts are the part ''.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm import text as tx

#: Words of a text.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in _MEASURES)


def _counts(column: pa.Array) -> pa.StructArray:
    """Words and distinct words of each text."""
    out = []
    for run in tx.runs(column):
        starts, ends, first = run.spans(tx.SPACED)
        row = tx.row_of(first)
        _, earlier = tx.repeated(run.hashes(starts, ends), row)
        n = np.diff(first)
        out.append(tx.struct(n=n, d=n - np.bincount(row[earlier], minlength=run.rows)))
    return tx.joined(out, pa.struct([("n", pa.int64()), ("d", pa.int64())]))


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "fails") -> DataFrame:
    """The documents with a struct of booleans, one a filter: whether they fail it.

    A: under 200 words.  B: distinct words are under half the words.  C: A-Z are
    more than 2 % of the code points.  D: one of ``#$%&*|``.  E: the text, a null or empty one too, is that of a
    smaller id anywhere in the table (a null id has none smaller and is none).

    E compares SHA-256 digests: the least id of each text is found with partial
    minima, and joined to the narrow rows by a digest dealt out anew where one text is a hot key (AQE).
    """
    words, digest, least = (tx.free_name([*docs.columns, out], n) for n in ("_words", "_digest", "_least"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    n, d = F.col(words)["n"], F.col(words)["d"]
    upper = F.length(text) - F.length(F.translate(text, _UPPER, ""))
    counted = tx.annotate(docs, text_col, lambda: _counts, "n bigint, d bigint", words)
    own = F.struct(
        (n < 200).alias("A"), (100 * d < 50 * n).alias("B"), (100 * upper > 2 * F.length(text)).alias("C"), text.rlike("[#$%&*|]").alias("D"),
    )
    marked = counted.withColumn(out, own).withColumn(digest, F.unhex(F.sha2(text, 256)))
    first = docs.select(F.unhex(F.sha2(text, 256)).alias(digest), F.col(f"`{id_col}`").alias(least)).groupBy(digest).agg(F.min(least).alias(least))
    found = marked.join(first, digest, "left")
    later = F.coalesce(F.col(f"`{id_col}`") > F.col(least), F.lit(False))
    return found.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(out).withField("E", later).alias(out))


def removal_steps(masks: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """The step (from 1) at which each order removes each mask, masks x orders; one more than there are filters where none does.

    ``masks``: bit f is set where filter f fails.  ``orders``: filters by step, a row each.
    """
    n = orders.shape[1]
    fails = np.where(masks[:, None] >> np.arange(n) & 1, 0, n + 1)  # masks x filters
    place = np.argsort(orders, axis=1).T + 1  # filters x orders
    return np.minimum((fails[:, :, None] + place[None, :, :]).min(axis=1), n + 1)


def interactions(masks: np.ndarray, weights: np.ndarray, orders: np.ndarray) -> dict[str, np.ndarray]:
    """For each order and step (orders x filters): the measures of documents with these masks.

    ``weights``: masks x 3: how many documents, how many of them good, how many toxic.
    """
    n = orders.shape[1]
    step = removal_steps(masks, orders)

    def scattered(w: np.ndarray) -> np.ndarray:
        at = np.arange(len(orders)) * (n + 2) + step
        return np.bincount(at.ravel(), np.repeat(w, len(orders)), len(orders) * (n + 2)).reshape(len(orders), n + 2).astype(np.int64)[:, 1 : n + 1]

    total, good, toxic = weights.T
    removed = scattered(total)
    bits = (masks[:, None] >> np.arange(n) & 1).astype(np.int64)
    failing, alone = total @ bits, (total * (bits.sum(axis=1) == 1)) @ bits
    gained = np.bincount(orders.ravel(), removed.ravel(), n).astype(np.int64)
    return {
        "kept": total.sum() - np.cumsum(removed, axis=1),
        "removed": removed,
        "redundant": failing[orders] - removed,  # what fails a filter is removed by it or before it
        "unique_fails": alone[orders],
        "good_lost": scattered(good),
        "toxic_lost": scattered(toxic),
        "shapley": gained[orders],
    }


def audit(failed: DataFrame, part: Column, good: Column, toxic: Column, fails: str = "fails") -> DataFrame:
    """One row per part, order of the filters and step, with the counts of :func:`interactions` over the part's rows.

    ``failed`` has the struct ``fails`` of booleans, one a filter, in the order of their letters.  ``good`` and ``toxic``: booleans, null is false.
    """
    names = failed.schema[fails].dataType.names
    mask = sum((F.when(F.col(fails)[f], 1 << k).otherwise(0) for k, f in enumerate(names)), F.lit(0))
    rows = failed.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.cast("int").alias("mask"), F.coalesce(good, F.lit(False)).cast("long").alias("good"), F.coalesce(toxic, F.lit(False)).cast("long").alias("toxic"))
    counts = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    orders = np.array(list(permutations(range(len(names)))))
    words = ["".join(names[f] for f in o) for o in orders]

    def steps(key: tuple, group: pd.DataFrame) -> pd.DataFrame:  # at most 2**filters rows
        found = interactions(group["mask"].to_numpy().astype(np.int64), group[["n", "good", "toxic"]].to_numpy(), orders)
        flat = {"part": key[0], "filter_order": np.repeat(words, len(names)), "step": np.tile(np.arange(1, len(names) + 1, dtype=np.int32), len(orders))}
        return pd.DataFrame(flat | {c: found[c].ravel() for c in _MEASURES})

    return counts.groupBy("part").applyInPandas(steps, AUDIT)
