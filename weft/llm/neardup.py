"""N-gram Jaccard join with a MinHash LSH forest (operator 1).

Documents are compared as sets of shingles of five words (A-Z lower-cased,
``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``); a text of one to four words is one shingle.
Two documents are linked where the Jaccard similarity is 0.8 or more.

1. Each text becomes a set digest (128 bits) and a signature of TREES x DEEPEST
   MinHash values.  Equal sets are one representative from here on.
2. A tree of the forest is the trie of the representatives' signatures in it.  Those that
   share a prefix of ``depth`` values stand under one node; each is tied to the
   least of the node, so a node costs as many rows as it has members, and ties make
   candidate components (:func:`components`).
3. In a component all pairs are verified exactly.  Large components are cut into
   blocks, and each pair of blocks is a work item of its own; a task returns, per
   representative, how many others it is linked to, never the pairs.
4. A link of similarity s has the chance 1 - (1 - s^depth)^TREES of being found, so
   the similarities of the links found so far estimate how many there are, and
   what share a shorter prefix would find.  While the estimated recall is below the
   target, the prefix is shortened to the longest that reaches it, and the components
   that grew are verified anew.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm import automaton as sa
from weft.llm import text as tx
from weft.session import materialize

SHINGLE = 5
#: Trees, and values in the longest prefix of one.
TREES, DEEPEST = 24, 6
#: Least estimated share of the links that is found.
RECALL = 0.9995
#: Representatives and shingles of a block, about.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 400_000

_rng = np.random.default_rng(20240517)
_FACTORS = _rng.integers(1, 1 << 63, size=TREES * DEEPEST, dtype=np.int64).astype(tx.U64) * tx.U64(2) + tx.U64(1)


def shingles(run: tx.Run) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a run's rows, row by row, and their rows."""
    _, _, hashes, first = sa.words(run)
    out, row = tx.grams(hashes, first, SHINGLE)
    n = np.diff(first)
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(few):
        each = np.zeros(len(few), dtype=tx.U64)
        for k in range(SHINGLE - 1):
            has = n[few] > k
            each[has] = each[has] * tx.U64(0x9E3779B97F4A7C15) + hashes[first[few[has]] + k]
        out = np.concatenate([out, tx.mix(each + n[few].astype(tx.U64))])
        row = np.concatenate([row, few])
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    new = np.ones(len(out), dtype=bool)
    if len(out):
        new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[new], row[new]


def _digest(run: tx.Run, shingle: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128 bits of each row's set and its size; of a text without words, of its bytes and 0."""
    n = np.bincount(row, minlength=run.rows)
    some = n > 0
    at = (np.cumsum(n) - n)[some]
    halves = []
    for salt in (0x8BB84B93962EACC9, 0x2D358DCCAA6C78A5):
        h = run.hashes(run.bounds[:-1], run.bounds[1:]) ^ tx.U64(salt)
        if len(shingle):
            h[some] = np.add.reduceat(tx.mix(shingle ^ tx.U64(salt)), at)
        halves.append(tx.mix(h + n.astype(tx.U64)).astype(np.int64))
    return halves[0], halves[1], n


def _set_of(run: tx.Run) -> pa.StructArray:
    a, b, n = _digest(run, *shingles(run))
    return tx.struct(h1=a, h2=b, n=n.astype(np.int64))


def _signed(run: tx.Run) -> pa.StructArray:
    shingle, row = shingles(run)
    a, b, n = _digest(run, shingle, row)
    some = np.flatnonzero(n)
    sign = np.zeros((run.rows, len(_FACTORS)), dtype=np.uint32)
    if len(some):
        at = (np.cumsum(n) - n)[some]
        for k, f in enumerate(_FACTORS):
            sign[some, k] = np.minimum.reduceat((shingle * f) >> tx.U64(32), at)
    raw = sign.astype(">u4").view(np.uint8).reshape(-1)
    return tx.struct(h1=a, h2=b, n=n.astype(np.int64), sign=tx.binaries(raw, 4 * len(_FACTORS) * np.arange(run.rows + 1)))


def with_sets(docs: DataFrame, text_col: str, out: str, signed: bool = False) -> DataFrame:
    """The documents with a struct of their set's digest (h1, h2), its size n, and, if asked for, the signature."""
    fields = [("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64())] + ([("sign", pa.binary())] if signed else [])
    ddl = "h1 bigint, h2 bigint, n bigint" + (", sign binary" if signed else "")
    one = _signed if signed else _set_of

    def make():
        return lambda column: tx.joined([one(run) for run in tx.runs(column)], pa.struct(fields))

    return tx.annotate(docs, text_col, make, ddl, out)


def components(edges: DataFrame) -> DataFrame:
    """For each node of the undirected edges (a, b), the least node of its component: (node, root).

    Alternates the two star operations (each node's larger, then its smaller
    neighbours are tied to the least node of the neighbourhood) until nothing
    changes.  Each round is written to the shared folder; the work on a node
    is grouped minimums and joins, which Spark can split.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = materialize(small.select("e.a", "e.b").where("a <> b").distinct())
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == before:
            break
        before = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b"))).distinct()


def _ties(reps: DataFrame, depth: int, alike: float) -> DataFrame:
    """Edges between the representatives under a node of ``depth`` values and the least of them."""
    prefix = F.expr(f"substring(sign, tree * {4 * DEEPEST} + 1, {4 * depth})")
    # a set of n shingles is at most n / (n + 1) alike to another that isn't its equal
    under = reps.where(F.col("n") >= alike * (F.col("n") + 1) - 1e-9).select("rid", "sign", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("rid", F.xxhash64("tree", prefix).alias("key"))
    nodes = under.groupBy("key").agg(F.min("rid").alias("least"), F.count("*").alias("members")).where("members > 1").drop("members")
    return under.join(nodes.hint("merge"), "key").where("rid <> least").select(F.col("rid").alias("a"), F.col("least").alias("b"))


_ITEM = "rid long, root long, links long, likeness array<bigint>"
#: Bins of the similarities of links, from ``alike`` to 1.
BINS = 20


def _verify(docs: DataFrame, members: DataFrame, alike: float) -> DataFrame:
    """Links of the representatives in ``members`` (rid, comp, mult, n, rep: id and text hash of a document) within their components.

    ``docs`` has doc_id, text and raw, the text's hash.
    """
    sizes = members.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    dealt = members.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")))
    # merge joins here and in _ties: neither side has a bound, and the plan is the same at every size
    own = docs.join(dealt.hint("merge"), docs.doc_id.eqNullSafe(F.col("rep.doc_id")) & (docs.raw == F.col("rep.raw")))
    own = own.select("rid", "comp", "block", "blocks", "mult", "text").dropDuplicates(["rid"])
    # every pair of blocks (i, j), i <= j, is an item; a member is in the items of its block
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    items = own.select("rid", "mult", "text", "comp", "block", other).select("rid", "mult", "text", "comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    placed = items.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "rid")
    return placed.mapInArrow(_verifier(alike), T.StructType.fromDDL(_ITEM))


def _verifier(alike: float):
    names = T.StructType.fromDDL(_ITEM).names

    def run(batches):
        key, held = None, []
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)).to_numpy() for c in ("comp", "i", "j")]
            n = b.num_rows
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
                if lo == hi:
                    continue
                here = tuple(int(c[lo]) for c in cols)
                if key is not None and here != key:
                    yield from _item(key, held, alike, names)
                    held = []
                key = here
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from _item(key, held, alike, names)
        tx.give_back()

    return run


def _item(key, held, alike: float, names):
    table = pa.Table.from_batches(held)
    rid, mult, block = (table.column(c).to_numpy() for c in ("rid", "mult", "block"))
    shingle, row = [], []
    for part in tx.runs(table.column("text")):
        s, r = shingles(part)
        shingle.append(s)
        row.append(r + part.lo)
    found = links(np.concatenate(shingle), np.concatenate(row), len(rid), alike, None if key[1] == key[2] else block)
    if not len(found[0]):
        return
    a, b, s = found
    n = len(rid)
    count = np.bincount(a, mult[b], n) + np.bincount(b, mult[a], n)
    kind = np.minimum(((s - alike) / (1 - alike + 1e-9) * BINS).astype(np.int64), BINS - 1)
    likeness = np.bincount(a * BINS + kind, minlength=n * BINS)
    root = roots(n, a, b, rid)
    some = np.flatnonzero(count)
    bins = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BINS), pa.array(likeness.reshape(n, BINS)[some].ravel()))
    yield pa.RecordBatch.from_arrays([pa.array(rid[some]), pa.array(rid[root[some]]), pa.array(count[some].astype(np.int64)), bins], names=names)


def next_depth(found: np.ndarray, depth: int, alike: float, recall: float) -> int:
    """The longest prefix, of ``depth`` values at most, that is expected to find ``recall`` of the links, from those found by bins of similarity.

    A link more is supposed in each bin, so that a prefix too long to find any is seen to be.
    """
    s = alike + (1 - alike) * np.arange(BINS) / BINS
    chance = lambda d: 1 - (1 - s**d) ** TREES
    there = (found + 1) / chance(depth)
    while depth > 1 and (there * chance(depth)).sum() < recall * there.sum():
        depth -= 1
    return depth


def links(shingle: np.ndarray, row: np.ndarray, n: int, alike: float, block: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows whose sets are at least ``alike`` alike, and how alike: within one block, or between two.

    Common shingles are counted for all pairs at once, as a product of the
    rows' incidence matrix with itself, some hundred thousand places at a time.
    """
    size = np.bincount(row, minlength=n).astype(np.float64)
    order = np.argsort(shingle, kind="stable")
    shingle, row = shingle[order], row[order]
    same = np.zeros(len(shingle) + 1, dtype=bool)
    same[1:-1] = shingle[1:] == shingle[:-1]
    shared = same[1:] | same[:-1]
    shingle, row = shingle[shared], row[shared]
    column = np.cumsum(np.append([0], (shingle[1:] != shingle[:-1]).astype(np.int64))) if len(shingle) else np.zeros(0, dtype=np.int64)
    left = np.arange(n) if block is None else np.flatnonzero(block == block.min())
    right = np.arange(n) if block is None else np.flatnonzero(block != block.min())
    if not len(column) or not len(left) or not len(right):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    width = max(256, (1 << 22) // n)
    for lo in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        have = np.zeros((n, min(width, int(column[-1]) + 1 - lo)), dtype=np.float32)
        have[row[a:b], column[a:b] - lo] = 1
        common += have[left] @ have[right].T
    out = []
    for k in range(0, len(left), 256):  # some rows at a time: the table of similarities isn't held whole
        c = common[k : k + 256].astype(np.float64)
        likeness = c / (size[left[k : k + 256], None] + size[None, right] - c)
        i, j = np.nonzero(likeness >= alike - 1e-12)
        out.append((left[k + i], right[j], likeness[i, j]))
    a, b, s = (np.concatenate(x) for x in zip(*out, strict=True))
    if block is None:
        once = a < b
        a, b, s = a[once], b[once], s[once]
    return a, b, s


def roots(n: int, a: np.ndarray, b: np.ndarray, rid: np.ndarray) -> np.ndarray:
    """For each row the row of least rid in its component of the links (a, b)."""
    order = np.argsort(rid, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    low, x, y = np.arange(n), rank[a], rank[b]
    while True:
        new = low.copy()
        np.minimum.at(new, x, low[y])
        np.minimum.at(new, y, low[x])
        new = new[new]
        if (new == low).all():
            return order[low[rank]]
        low = new


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alike: float = 0.8, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Representatives with their classes, and the documents' sets.

    The first table has a row per distinct set: h1, h2, class_id (the least id
    of a document in the component of links), n_copies (documents with this
    set) and n_links (other documents at least ``alike`` alike, copies
    included).  The second has a row per document: doc_id and h1, h2 of its set.

    A null text stands for an empty one.  Texts without words are alike only to
    texts that are the same byte by byte.  Null ids count as documents; a class
    without any id has none.  An empty table gives empty tables.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("raw"))
    signed = with_sets(own, "text", "_set", signed=True)
    sketched = materialize(signed.select("doc_id", "raw", "_set.*"))
    grouped = sketched.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep_doc"), F.min(F.struct("doc_id", "raw")).alias("rep"), F.count("*").alias("mult"), F.first("n").alias("n"), F.first("sign").alias("sign"))
    reps = materialize(grouped.withColumn("rid", F.monotonically_increasing_id()))
    depth, results, old = DEEPEST, None, None
    while True:
        comps = materialize(components(_ties(reps, depth, alike)).join(reps.drop("sign"), F.col("node") == F.col("rid")).select("rid", F.col("root").alias("comp"), "mult", "rep", "n"))
        size = comps.groupBy("comp").agg(F.count("*").alias("size"))
        if old is None:
            results = materialize(_verify(own, comps, alike))
        else:  # a component that has the size it had is the same one
            same = size.join(old, ["comp", "size"], "left_semi").select("comp")
            kept = results.join(comps.join(same, "comp", "left_semi").select("rid"), "rid", "left_semi")
            results = materialize(kept.unionByName(_verify(own, comps.join(same, "comp", "left_anti"), alike)))
        old = size
        found = np.array([x or 0 for x in results.agg(*(F.sum(F.col("likeness")[k]) for k in range(BINS))).first()], dtype=float)
        shorter = next_depth(found, depth, alike, recall)
        if shorter == depth:
            break
        depth = shorter
    linked = results.groupBy("rid").agg(F.sum("links").alias("links"))
    joined = components(results.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    told = reps.drop("sign").join(linked, "rid", "left").join(joined.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    told = materialize(told)
    least = told.groupBy("root").agg(F.min("rep_doc").alias("class_id"))
    out = told.join(least, "root").select("h1", "h2", "class_id", F.col("mult").alias("n_copies"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    return out, sketched.select("doc_id", "h1", "h2")


def join(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, class_id, n_links (see :func:`classes`)."""
    found, sets = classes(docs, **options)
    return sets.join(found, ["h1", "h2"]).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, but one of each class: that with the least id (ties and null ids: any one).

    Texts without words, null ones included, all stay.  Columns are as in the input.
    """
    from pyspark.sql import Window

    found, _ = classes(docs, id_col, text_col, **options)
    mark, top, lone, f1, f2, own_class = (tx.free_name(docs.columns, x) for x in ("_set", "_top", "_lone", "_f1", "_f2", "_class"))
    # texts without words stand alone: each has a number of its own
    sets = with_sets(docs, text_col, mark).withColumn(lone, F.when(F.col(f"{mark}.n") == 0, F.monotonically_increasing_id()))
    other = found.select(F.col("h1").alias(f1), F.col("h2").alias(f2), F.col("class_id").alias(own_class))
    own = sets.join(other, (F.col(f"{mark}.h1") == F.col(f1)) & (F.col(f"{mark}.h2") == F.col(f2)))
    by = [F.col(own_class), F.when(F.col(own_class).isNull(), F.col(f"{mark}.h1")), F.col(lone)]
    # row_number() = 1: every task keeps a row a class before the shuffle, so a large class doesn't gather
    ranked = own.withColumn(top, F.row_number().over(Window.partitionBy(*by).orderBy(F.col(f"`{id_col}`").asc_nulls_last(), F.xxhash64(F.col(f"`{text_col}`")))))
    return ranked.where(F.col(top) == 1).select(*(docs_col(c) for c in docs.columns))


def docs_col(name: str):
    return F.col(f"`{name}`")
