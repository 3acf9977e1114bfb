"""WARC Merkle fixity audit of replicas (operator 10).

Pages become WARC records in the order of their keys; FILE_RECORDS of them make a file,
and a record has an offset and a length in it.  Every record is a leaf with
the sha256 of its bytes; an inner node has the sha256 of its FANOUT children's
digests, in order, each with the offset range it covers.  Nodes of a file's records
end in the file's root, those of the files' roots in the replica's.  An audit
compares the two replicas' roots and goes down only into children of nodes that
differ, level by level, to the records that do.

All of it is Spark SQL on narrow rows: record bytes are hashed where they are
read and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.session import materialize

#: Records of a file (a power of FANOUT), and children of a node.
FILE_RECORDS, FANOUT = 1024, 32


def record(key: Column, url: Column, html: Column) -> Column:
    """The bytes of a WARC/1.1 response record; nulls stand for empty texts."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def manifest(records: DataFrame, key_col: str = "key", bytes_col: str = "bytes", **extra: Column) -> DataFrame:
    """Where each record of a replica lies, as a written table: key, place, file, offset, length, digest.

    Records are ordered by key (nulls first), equal keys by digest; equal rows
    are records of their own.  ``place`` counts from 0 over all of them, so a
    file has FILE_RECORDS whatever keys repeat.  ``extra`` columns of a record go with it.
    """
    raw = F.col(f"`{bytes_col}`")
    narrow = records.select(F.col(f"`{key_col}`").alias("key"), F.octet_length(raw).cast("bigint").alias("length"), F.sha2(raw, 256).alias("digest"), *(c.alias(k) for k, c in extra.items()))
    ranged = narrow.repartitionByRange("key", "digest").sortWithinPartitions("key", "digest")
    mark = F.monotonically_increasing_id()
    placed = materialize(ranged.withColumn("part", F.shiftright(mark, 33)).withColumn("nth", mark.bitwiseAND((1 << 33) - 1)))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))  # one row per task
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    counted = placed.join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.col("nth")).withColumn("file", F.expr(f"place div {FILE_RECORDS}"))
    upto = F.sum("length").over(Window.partitionBy("file").orderBy("place"))  # FILE_RECORDS rows at most
    return materialize(counted.select("key", "place", "file", (upto - F.col("length")).alias("offset"), "length", "digest", *extra))


def tree(leaves: DataFrame) -> DataFrame:
    """All nodes over ``leaves`` (place, file, offset, length, digest), as a written table: level, node, start, stop, digest.

    Level 0 has the records, by place; ``start`` and ``stop`` are offsets in
    the file below the level of whole files, and file numbers from there on.
    The highest level has one node, or none where there are no leaves.
    """
    now = leaves.select(F.lit(0).alias("level"), F.col("place").alias("node"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("stop"), "digest")
    levels, level, in_file = [now], 0, 1
    while True:
        if in_file == FILE_RECORDS:  # from here on ranges are of files
            now = now.withColumn("start", F.col("node")).withColumn("stop", F.col("node") + 1)
        if in_file >= FILE_RECORDS and now.limit(2).count() <= 1:
            break
        level, in_file = level + 1, in_file * FANOUT
        child = F.struct("node", F.concat_ws(":", "start", "stop", "digest").alias("d"), "start", "stop")
        # a node has FANOUT children at most
        grouped = now.groupBy(F.expr(f"node div {FANOUT}").alias("up")).agg(F.sort_array(F.collect_list(child)).alias("c"))
        digest = F.sha2(F.array_join(F.transform("c", lambda x: x["d"]), "|"), 256)
        now = materialize(grouped.select(F.lit(level).alias("level"), F.col("up").alias("node"), F.array_min(F.transform("c", lambda x: x["start"])).alias("start"), F.array_max(F.transform("c", lambda x: x["stop"])).alias("stop"), digest.alias("digest")))
        levels.append(now)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return materialize(out)


def differing(one: DataFrame, other: DataFrame) -> DataFrame:
    """The places whose leaves differ, found from the roots down: place, expected and found digest (null where a side has none).

    Each level joins only the children of nodes that differ above, on the two
    sides, and keeps those that differ again.
    """
    top = max((x.agg(F.max("level")).first()[0] for x in (one, other)), key=lambda v: -1 if v is None else v)
    if top is None:
        return one.select(F.col("node").alias("place"), F.col("digest").alias("expected"), F.col("digest").alias("found"))
    suspect = None
    for level in range(top, -1, -1):
        sides = []
        for side in (one, other):
            at = side.where(F.col("level") == level)
            if suspect is not None:
                at = at.withColumn("up", F.expr(f"node div {FANOUT}")).join(suspect, "up", "left_semi")
            sides.append(at.select("node", F.concat_ws(":", "start", "stop", "digest").alias("sum"), "digest"))
        a, b = sides[0].alias("a"), sides[1].alias("b")
        bad = a.join(b, F.col("a.node") == F.col("b.node"), "full").where(~F.col("a.sum").eqNullSafe(F.col("b.sum")))
        bad = materialize(bad.select(F.coalesce("a.node", "b.node").alias("up"), F.col("a.digest").alias("expected"), F.col("b.digest").alias("found")))
        suspect = bad.select("up")
    return bad.withColumnRenamed("up", "place")


def audit(manifest_: DataFrame, held: DataFrame) -> DataFrame:
    """The records of a replica that aren't as its manifest has them.

    ``held`` has what is read back at the manifest's ranges: place, offset,
    length and digest (a row missing: nothing could be read).  Returns key,
    place, file, offset, length, expected, found, and ``damage``: ``missing``,
    ``length`` (another number of bytes), ``bytes`` (others), or ``extra`` (a
    place that the manifest hasn't).
    """
    first = tree(manifest_)
    second = tree(held.select("place", F.expr(f"place div {FILE_RECORDS}").alias("file"), "offset", "length", "digest"))
    bad = differing(first, second)
    own = manifest_.select("key", "place", "file", "offset", "length")
    read = held.select("place", F.col("length").alias("read"))
    damage = F.when(F.col("expected").isNull(), "extra").when(F.col("found").isNull(), "missing").when(F.col("read") != F.col("length"), "length").otherwise("bytes")
    return bad.join(own, "place", "left").join(read, "place", "left").select("key", "place", "file", "offset", "length", "expected", "found", damage.alias("damage"))
