from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from tests.llm import helpers as h
from weft.llm import filter_audit, queries

SF = "/root/testdata/sf0.001"


def plain(rows):
    """rows: (part, failed letters, good, toxic); every order run through, filter by filter."""
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        gained = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                failing = [r for r in own if f in r[1]]
                gained[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(gained[order[step - 1]])
    return out


def judged(spark, docs, marks):
    failed = filter_audit.failures(docs, out="f")
    found = filter_audit.audit(failed.join(marks, "doc_id", "left"), F.col("source"), F.col("good"), F.col("bad"), fails="f")
    return {(r[0], r[1], r[2]): list(r[3:]) for r in found.collect()}


def failed_letters(docs):
    out = []
    for d, t in docs:
        t = t or ""
        w = t.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
        w = [x for x in w if x]
        f = set()
        f |= {"A"} if len(w) < 200 else set()
        f |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        f |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else set()
        f |= {"D"} if set(t) & set("#$%&*|") else set()
        f |= {"E"} if d is not None and any(e is not None and e < d and (u or "") == t for e, u in docs) else set()
        out.append(f)
    return out


def test_awkward_rows_match_every_order_run_through(spark):
    more = [" ".join(f"w{i}" for i in range(250)), " ".join(f"W{i} #" for i in range(250)), "é" * 50 + "A", "x " * 400, "x " * 400, "x " * 400]
    docs = h.awkward(spark, more).withColumn("source", F.when(F.col("doc_id") > 5, "b").when(F.col("doc_id") > 2, ""))
    docs = docs.withColumn("_words", F.lit(1)).withColumn("_digest", F.lit(2)).withColumn("_least", F.lit(3)).withColumn("fails", F.lit(4))
    marks = spark.createDataFrame([(0, True, None), (7, True, True), (8, None, True), (99, True, True)], "doc_id bigint, good boolean, bad boolean")
    rows = docs.select("doc_id", "text", "source").collect()
    said = {r.doc_id: (bool(r.good), bool(r.bad)) for r in marks.collect()}
    letters = failed_letters([(r.doc_id, r.text) for r in rows])
    expected = plain([(r.source or "", f, *said.get(r.doc_id, (False, False))) for r, f in zip(rows, letters, strict=True)])
    assert judged(spark, docs, marks) == expected
    assert filter_audit.failures(docs, out="f").columns == [*docs.columns, "f"]
    assert judged(spark, h.none(spark), marks) == {}


def test_query_matches_its_sql(spark):
    for name in ("documents", "labels"):
        duckdb.sql(f"create or replace view {name} as select * from '{SF}/{name}.parquet'")
    names = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    got = queries.op13_filter_audit(spark, SF).select(names).collect()
    want = duckdb.sql(f"select {', '.join(names)} from ({queries.SQL['op13_filter_audit']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) % 600 == 0 and len(want) > 0
