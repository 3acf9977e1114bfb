import hashlib

from pyspark.sql import functions as F

from weft.llm import fixity


def records(spark, n, extra=()):
    rows = [(i, f"http://h/{i}", "page " * (i % 7)) for i in range(n)] + list(extra)
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return pages.select("page_id", fixity.record(F.col("page_id"), F.col("url"), F.col("html")).alias("bytes"))


def held(listed):
    return listed.select("place", "offset", "length", "digest")


def test_manifest(spark):
    odd = [(None, None, None), (5, "again", ""), (5, "again", "")]
    got = fixity.manifest(records(spark, 2100, odd), "page_id").orderBy("place").collect()
    assert [r.place for r in got] == list(range(2103)) and got[0].key is None
    assert [r.file for r in got] == [i // 1024 for i in range(2103)]
    at = 0
    for r in got:
        at = 0 if r.place % 1024 == 0 else at
        assert r.offset == at
        at += r.length
    first = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:>\r\nWARC-Target-URI: \r\nContent-Type: text/html\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    assert got[0].digest == hashlib.sha256(first).hexdigest()


def test_audit_finds_each_damage_and_no_other(spark):
    listed = fixity.manifest(records(spark, 2100), "page_id")
    whole = held(listed)
    assert fixity.audit(listed, whole).collect() == []
    damaged = (
        whole.where("place <> 1500").withColumn("digest", F.when(F.col("place") == 3, "00").otherwise(F.col("digest")))
        .withColumn("length", F.when(F.col("place") == 2099, F.lit(1).cast("bigint")).otherwise(F.col("length")))
        .union(spark.createDataFrame([(2100, 0, 7, "ff")], "place bigint, offset bigint, length bigint, digest string"))
    )
    got = {r.place: (r.damage, r.key) for r in fixity.audit(listed, damaged).collect()}
    assert got == {3: ("bytes", 3), 1500: ("missing", 1500), 2099: ("length", 2099), 2100: ("extra", None)}
    assert fixity.audit(listed, whole.limit(0)).count() == 2100


def test_empty(spark):
    listed = fixity.manifest(records(spark, 0), "page_id")
    assert fixity.audit(listed, held(listed)).collect() == []


def test_tree_is_what_its_definition_says(spark):
    listed = fixity.manifest(records(spark, 40), "page_id")
    nodes = fixity.tree(listed).collect()
    leaves = {r.node: f"{r.start}:{r.stop}:{r.digest}" for r in nodes if r.level == 0}
    one = next(r for r in nodes if r.level == 1 and r.node == 1)
    assert one.digest == hashlib.sha256("|".join(leaves[i] for i in range(32, 40)).encode()).hexdigest()
    assert max(r.level for r in nodes) == 2
