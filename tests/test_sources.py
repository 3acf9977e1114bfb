"""Readers keep or report every record and cell; the store takes retries and deletes."""

import json

import pytest
from pyspark.sql import functions as F

from weft.sources import records as rec
from weft.sources.bundles import read_bundle_pages
from weft.streaming import read_record_stream

CSV = 'a,b\n"x\ny",1\n"He said ""hi"", ok",2\n\nshort\n1,2,3\n1,2,3,4\nz,12345678901234567890\n'


def read(df):
    rows = df.select(F.to_json("record").alias("r"), "_corrupt_record").collect()
    return [json.loads(r.r) for r in rows if r._corrupt_record is None], [r._corrupt_record for r in rows if r._corrupt_record is not None]


CSV_GOOD = [{"a": "x\ny", "b": 1}, {"a": 'He said "hi", ok', "b": 2}, {"a": "short"}, {"a": "z", "b": "12345678901234567890"}]


def test_csv_cells(spark, tmp_path):
    (tmp_path / "x.csv").write_text(CSV)
    good, bad = read(rec.read_csv_records(spark, str(tmp_path)))
    assert [{k: v for k, v in g.items() if v is not None} for g in good] == CSV_GOOD
    assert sorted(bad) == ["1,2,3", "1,2,3,4"]
    with pytest.raises(Exception, match="Malformed record"):
        rec.read_csv_records(spark, str(tmp_path), on_malformed="fail").collect()
    (tmp_path / "x.csv").write_text("a,b\nshort\n1,2\n")
    assert len(rec.read_csv_records(spark, str(tmp_path), on_malformed="fail").collect()) == 2


def test_csv_stream_has_header_and_types(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.csv").write_text(CSV)
    got = []
    q = read_record_stream(spark, str(tmp_path / "in"), "csv").writeStream.foreachBatch(lambda b, _: got.append(read(b))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [{k: v for k, v in g.items() if v is not None} for g in got[0][0]] == CSV_GOOD and len(got[0][1]) == 2


LINES = '{"a":1}{"a":2}\n{"a":"} {"}\n\n{"a":3} {"a":[{"b":1}]}[4]\n{"a":5} oops\n{"a":\n'


def test_json_values_on_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text(LINES)
    good, bad = read(rec.read_json_records(spark, str(tmp_path)))
    assert good == [{"a": 1}, {"a": 2}, {"a": "} {"}, {"a": 3}, {"a": [{"b": 1}]}, [4], {"a": 5}]
    assert sorted(bad) == ["oops", '{"a":'] or sorted(bad) == ["oops\n", '{"a":']


def test_json_values_of_files(spark, tmp_path):
    (tmp_path / "x.json").write_text('{\n "a": 1\n}\n{\n "a": 2\n}\n[{"a": 3},\n {"a": 4}]\n{broken')
    good, bad = read(rec.read_json_records(spark, str(tmp_path), multi_line=True))
    assert good == [{"a": 1}, {"a": 2}, {"a": 3}, {"a": 4}] and bad == ["{broken"]


def test_bundle_pages_by_line_and_file(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"resourceType":"Bundle","n":1}\n{"resourceType":"Bundle","n":2}\n')
    (tmp_path / "y.json").write_text('{\n "resourceType": "Bundle",\n "n": 3\n}')
    got = read_bundle_pages(spark, str(tmp_path)).select(F.try_variant_get("page", "$.n", "int").alias("n")).collect()
    assert sorted(r.n for r in got) == [1, 2, 3]


def test_store_twice_delete_append(spark, tmp_path):
    from weft.operators import definitions as d

    doc = {"resourceType": "StructureDefinition", "url": "http://u/1", "type": "Patient", "name": "n", "snapshot": {"element": [{"path": "Patient"}, {"path": "Patient.id"}]}}
    docs = spark.createDataFrame([(json.dumps(doc),)], "t string").select(F.parse_json("t").alias("doc"))
    root = str(tmp_path)
    got = d.ingest(docs)
    assert d.store(got, root) == d.store(got, root)
    defs, els = d.read_store(spark, root)
    assert defs.count() == 1 and els.count() == 2
    ids = defs.select(F.col("id").alias("structureDefinitionId"))
    kept = spark.createDataFrame(els.collect(), els.schema)
    d.delete_elements(ids, root)
    assert d.read_store(spark, root)[1].count() == 0
    d.append_elements(kept, root)
    assert d.read_store(spark, root)[1].count() == 2
    same = spark.createDataFrame([("http://u/1",), ("http://u/1",), ("zz",)], "identifier string")
    assert sorted(str(r.url) for r in d.resolve_identifiers(same, defs).collect()) == ["None", "http://u/1", "http://u/1"]


def test_code_lookup_compares_texts(spark):
    from weft.operators.lookup import code_lookup_table

    codes = spark.createDataFrame([("1", "one"), ("M", "em")], "code string, v string")
    got = code_lookup_table(spark.createDataFrame([(1,), (2,), (None,)], "k bigint"), "k", codes, "code", "v", "out", "none").collect()
    assert sorted(r.out for r in got) == ["none", "none", "one"]


def test_scratch_folder_must_be_shared(monkeypatch):
    from weft import session

    class Conf(dict):
        def get(self, k, d=None):
            return d

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="checkpoint"):
        session.ensure_checkpoint_dir(Cluster())


def test_error_text_with_line_separator(spark):
    from pyspark.sql import types as T

    from weft.functions.coerce import json_text
    from weft.functions.paths import Val

    got = spark.createDataFrame([("a b",)], "s string").select(json_text(Val(F.col("s"), T.StringType())).alias("j")).first().j
    assert json.loads(got) == "a b"


MIXED = {"1.csv": "a,b\n1,2\n,\n9,8,\n", "2.csv": "b,a\n3,4\n5,6,7\n", "3.csv": "\n\n﻿a,b,c\n5,6,7\n\n8\n", "4.csv": '"x\n""y""",a,a,\n1,2,3,4\n', "5.csv": "b,a\n", "6.csv": "", "7.csv": ",".join(f"k{i}" for i in range(90)) + "\n" + ",".join(str(i) for i in range(90)) + "\n"}
MIXED_GOOD = [{"a": 1, "b": 2}, {}, {"a": 9, "b": 8}, {"b": 3, "a": 4}, {"a": 5, "b": 6, "c": 7}, {"a": 8}, {'x\n"y"': 1, "a": 3, "_c3": 4}, {f"k{i}": i for i in range(90)}]


def _same(read_, multi_line=True):
    good, bad = read_
    rows = sorted(json.dumps({k: v for k, v in g.items() if v is not None}, sort_keys=True) for g in good)
    want = [g for g in MIXED_GOOD if multi_line or "_c3" not in g]
    return rows == sorted(json.dumps(g, sort_keys=True) for g in want) and bad == ["5,6,7"]


def test_csv_files_have_their_own_headers(spark, tmp_path):
    for name, text in MIXED.items():
        (tmp_path / name).write_text(text)
    assert _same(read(rec.read_csv_records(spark, str(tmp_path))))
    (tmp_path / "4.csv").write_text("")
    assert _same(read(rec.read_csv_records(spark, str(tmp_path), multi_line=False)), False)
    assert read(rec.read_csv_records(spark, str(tmp_path / "6.csv"))) == ([], [])
    texts = [json.loads(r[0]) for r in rec.read_csv_records(spark, str(tmp_path / "[12].csv"), cell_typing=False).where("_corrupt_record is null").select(F.to_json("record")).collect()]
    assert {"a": "1", "b": "2"} in texts and {"b": "3", "a": "4"} in texts


def test_csv_stream_reads_headers_of_later_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    got = [[], []]

    def keep(batch, _):
        good, bad = read(batch)
        got[0].extend(good)
        got[1].extend(bad)

    for names in (["1.csv", "2.csv", "5.csv"], ["3.csv", "4.csv", "6.csv", "7.csv"]):  # the second lot comes to a running checkpoint
        for name in names:
            (tmp_path / "in" / name).write_text(MIXED[name])
        stream = read_record_stream(spark, str(tmp_path / "in"), "csv", max_files_per_trigger=2)
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert _same(got)
