"""Value sets in a table, counts of a run, CSV of dynamic items."""

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from weft.operators.map_in import map_in
from weft.plans.catalog import cfg, fm
from weft.sinks import counted, leaf_paths, write_csv, write_csv_dynamic, write_ndjson


csv.field_size_limit(1 << 20)


def _messages(r):
    return [(x.id, [e.message for e in x.errors]) for x in r.df.select("id", "errors").orderBy("id").collect()]


def test_value_sets(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "A"), (3, None), (4, " "), (5, "7"), (6, "a"), (7, "z" * 100_000)], "id int, c string")
    sets = spark.createDataFrame([("u", "a"), ("u", "a"), ("u", None), ("u", "7"), ("w", "A"), (None, "q")], "url string, code string")
    m = cfg("S", "Basic", fm(0, "c", "code.text", "VALUESET", {"valueSetUrl": "u"}))
    bad = "Value '{}' is not valid according to ValueSet 'u'."
    got = _messages(map_in(rows, m, keep=("id",), value_sets=sets))
    assert got == [(1, []), (2, [bad.format("A")]), (3, []), (4, []), (5, []), (6, []), (7, [bad.format("z" * 100_000)])]
    # a set without codes, no table, an empty one: all are accepted; a blank url stays an error
    none = [(k, []) for k in range(1, 8)]
    for url, table in (("other", sets), ("u", None), ("u", sets.limit(0))):
        assert _messages(map_in(rows, cfg("S", "Basic", fm(0, "c", "code.text", "VALUESET", {"valueSetUrl": url})), keep=("id",), value_sets=table)) == none
    got = _messages(map_in(rows, cfg("S", "Basic", fm(0, "c", "code.text", "VALUESET", {})), keep=("id",), value_sets=sets))
    assert got[0] == (1, ["Configuration error: Missing ValueSet URL."])


def test_value_sets_after_default_and_numbers(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, None), (3, 6.5)], "id int, n double")
    sets = spark.createDataFrame([("u", 5), ("u", 9)], "url string, code int")
    m = cfg("S", "Basic", fm(0, "n", "value", "VALUESET", {"valueSetUrl": "u"}, "DEFAULT_VALUE", {"value": 9}))
    assert _messages(map_in(rows, m, keep=("id",), value_sets=sets)) == [(1, []), (2, []), (3, ["Value '6.5' is not valid according to ValueSet 'u'."])]


def test_value_sets_with_dynamic_records(spark):
    rows = spark.createDataFrame([(1, '{"c":"a"}'), (2, '{"c":["a"]}'), (3, '{"c":{"a":1}}'), (4, "{}")], "id int, t string").select("id", F.parse_json("t").alias("record"))
    sets = spark.createDataFrame([("u", "a")], "url string, code string")
    m = cfg("S", "Basic", fm(0, "c", "code", "VALUESET", {"valueSetUrl": "u"}))
    got = _messages(map_in(rows, m, keep=("id",), variant_col="record", value_sets=sets))
    assert got == [(1, []), (2, []), (3, ["Value '[object Object]' is not valid according to ValueSet 'u'."]), (4, [])]


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_counts_of_a_run(spark, tmp_path, n):
    rows = spark.range(n).select(F.col("id"), F.when(F.col("id") % 3 != 0, F.lit("x")).alias("a"), F.when(F.col("id") % 2 != 0, F.lit("y")).alias("b"))
    r = map_in(rows, cfg("C", "Basic", fm(0, "a", "a", "REQUIRED"), fm(1, "b", "b", "REQUIRED")))
    out, seen = counted(r.df)
    write_ndjson(out, str(tmp_path / "out"))
    a, b = sum(k % 3 == 0 for k in range(n)), sum(k % 2 == 0 for k in range(n))
    bad = sum(k % 3 == 0 or k % 2 == 0 for k in range(n))
    assert seen.get == {"records": n, "data": n - bad, "errors": bad, "field_errors": a + b}


def test_counts_of_other_rows(spark, tmp_path):
    out, seen = counted(spark.range(7))
    out.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"records": 7}


def test_counts_of_a_stream(spark, tmp_path):
    from weft.streaming import read_record_stream, start_map_in_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"a":"x"}\n{"a":""}\n{"bad": \n')
    m = cfg("C", "Basic", fm(0, "a", "a", "REQUIRED"))
    folder = lambda x: str(tmp_path / x)
    for k in (0, 1):
        start_map_in_stream(read_record_stream(spark, folder("in")), m, folder("out"), folder("ck"), variant_col="record", counts_dir=folder("counts")).awaitTermination()
        (tmp_path / "in" / f"b{k}.json").write_text('{"a":"y"}\n')
    got = {r.batch: (r.records, r.data, r.errors, r.field_errors) for r in spark.read.json(folder("counts")).collect()}
    assert got == {0: (3, 1, 2, 2), 1: (1, 1, 0, 0)}


def test_leaf_paths():
    assert leaf_paths({"a": {"b": 1, "c": {}}, "d": [{"e": 1}], "f": None}) == [("a", "b"), ("d",), ("f",)]


def _items(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", F.parse_json("t").alias("item"), F.when(F.col("t").contains("FAIL"), F.array(F.lit("e"))).otherwise(F.array().cast("array<string>")).alias("errors"))


def _written(path):
    """The parsed rows of the one file there, header first."""
    files = glob.glob(f"{path}/part-*")
    return [row for f in sorted(files) for row in csv.reader(open(f, newline=""))]


def test_csv_of_dynamic_items(spark, tmp_path):
    first = {"a": {"b": 'x "q", y\nz', "w": " s "}, "l": [1, None, [2, 3], {"o": 1}, True], "n": None, "q\"k": 1.5, "dot.ted": "t", " ?'\"[\\": 2, "": 3}
    texts = [json.dumps(first), '{"a":"whole","l":{"x":1},"more":1}', '{"FAIL":1}', '"text"', "[1]", "{}", json.dumps({"a": {"b": ""}, "l": [], "n": "x" * 200_000})]
    write_csv_dynamic(_items(spark, *texts).coalesce(1), str(tmp_path / "o"), first_by="k")
    got = _written(tmp_path / "o")
    assert got[0] == ["", " ?'\"[\\", "a.b", "a.w", "dot.ted", "l", "n", 'q"k']
    assert got[1] == ["3", "2", 'x "q", y\nz', " s ", "t", "1;;2,3;[object Object];true", "", "1.5"]
    assert got[2:] == [[""] * 8, [""] * 8, [*[""] * 6, "x" * 200_000, ""]]


def test_csv_columns_and_empty(spark, tmp_path):
    rows = _items(spark, '{"a":1,"b":2}', '{"b":3}')
    write_csv(rows.coalesce(1), str(tmp_path / "o"), columns=["b", "none", "a"])
    assert _written(tmp_path / "o") == [["b", "none", "a"], ["2", "", "1"], ["3", "", ""]]
    for k, own in enumerate((rows.limit(0), _items(spark, '{"FAIL":1}'), _items(spark, "{}"))):
        write_csv_dynamic(own, str(tmp_path / f"e{k}"))
        assert _written(tmp_path / f"e{k}") == []
    write_csv_dynamic(_items(spark, '{"a":1}', "{}", '{"a":" "}', '{"a":2}').coalesce(1), str(tmp_path / "one"))
    assert _written(tmp_path / "one") == [["a"], ["1"], ["2"]]
    with pytest.raises(ValueError):
        write_csv_dynamic(_items(spark, '{"a":1,"A":2}'), str(tmp_path / "c"))


def test_csv_of_structs_that_hold_dynamic_values(spark, tmp_path):
    rows = spark.createDataFrame([(1, '{"c":{"d":"x"}}'), (2, '{"c":"y"}')], "id int, t string").select(F.struct("id", F.parse_json("t").alias("v")).alias("item"), F.array().cast("array<string>").alias("errors"))
    write_csv(rows.coalesce(1), str(tmp_path / "o"))
    assert _written(tmp_path / "o") == [["id", "v.c.d"], ["1", "x"], ["2", ""]]
