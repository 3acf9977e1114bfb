"""Writes in any order: compiled records against a plain version of setting values one after another."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weft.operators.map_in import map_in
from weft.plans.config import FieldMapping, MappingConfig
from weft.sources.records import inline_records

LISTS = {"coding", "identifier", "extension", "name", "telecom", "contact", "entry", "link", "item", "profile"}
RECORDS = [
    {"s": "text", "n": 5, "o": {"a": 1, "coding": [{"code": "old", "system": "x"}]}, "l": [{"system": "phone", "v": 1}, {"system": "mail"}], "e": []},
    {"s": "other", "o": {"text": "t"}, "l": [{"system": "x"}], "vs": ["p", "q"]},
    {"n": 0, "vs": ["z"], "l": [1, {"system": "mail", "v": {"w": 2}}]},
    {},
]


def steps(path):
    out = []
    for part in path.split("."):
        name, *more = part.replace("[", "\n[").split("\n")
        out.append(name)
        out += [m[1:-1] for m in more]
    return out


def put(at, segs, value):
    """Writes ``value`` below the container ``at``."""
    seg, rest = segs[0], segs[1:]
    if isinstance(at, dict):
        if seg.startswith("?"):
            return
        if not rest:
            at[seg] = value
            return
        if not isinstance(at.get(seg), (dict, list)):
            at[seg] = [] if seg in LISTS else {}
        put(at[seg], rest, value)
    elif seg.isdigit():
        i = int(seg)
        while len(at) <= i:
            at.append({} if rest else None)
        if not rest:
            at[i] = value
            return
        if not isinstance(at[i], (dict, list)):
            at[i] = {}
        put(at[i], rest, value)
    elif seg.startswith("?"):
        key, text = seg[1:].split("=")
        text = text.strip("'")
        found = next((x for x in at if isinstance(x, dict) and x.get(key) == text), None)
        if found is None:
            found = {key: text}
            at.append(found)
        if rest:
            put(found, rest, value)
    elif not at:
        at.append({})
        put(at[0], segs, value)
    else:
        for x in at:
            if isinstance(x, dict):
                put(x, segs, value)


def plain(record, writes):
    out = {"resourceType": "Basic"}
    for source, target in writes:
        if source in record:
            put(out, steps(target), json.loads(json.dumps(record[source])))
    return out


def shown(x):
    """Without what JSON text can't tell: nulls of objects, and objects that hold nothing else."""
    if isinstance(x, dict):
        return {k: shown(v) for k, v in x.items() if v is not None}
    return [shown(v) for v in x] if isinstance(x, list) else x


def compiled(spark, writes):
    fms = tuple(FieldMapping(s, t, ordinal=i) for i, (s, t) in enumerate(writes))
    df = map_in(inline_records(spark, RECORDS), MappingConfig("c", "Basic", mappings=fms), variant_col="record", keep_original=False).df
    return [json.loads(r[0]) for r in df.select(F.to_json("item")).collect()]


NAMED = {
    "whole value between writes below it": [("s", "code.text"), ("o", "code"), ("n", "code.coding[0].code")],
    "value replaced, then written below twice": [("s", "a.b"), ("l", "a"), ("n", "a.v"), ("s", "a[?system='mail'].use")],
    "filter, then index, then values": [("s", "telecom[?system='mail'].value"), ("n", "telecom[0].rank"), ("s", "telecom[1]"), ("n", "telecom[?system='mail'].rank")],
    "values out of order": [("s", "tag[1]"), ("n", "tag[0]"), ("o", "tag"), ("s", "tag[2]")],
    "lists below a value that replaced writes": [("n", "x.y"), ("o", "x"), ("s", "x.coding[?system='x'].display"), ("n", "x.coding[2].code")],
    "scalar over containers over scalar": [("n", "a.b.c"), ("s", "a.b"), ("n", "a.b.c"), ("s", "a"), ("n", "a.d[1]")],
}


@pytest.mark.parametrize("name", sorted(NAMED))
def test_named_orders(spark, name):
    assert [shown(x) for x in compiled(spark, NAMED[name])] == [shown(plain(r, NAMED[name])) for r in RECORDS]


SOURCES = ["s", "n", "o", "l", "vs"]
TARGETS = ["code", "code.text", "code.coding[0].code", "code.coding[?system='x'].code", "code.coding", "code.coding.display", "code.coding[1]", "name", "name[0]", "name.text", "name[1].given[0]", "name[?use='text'].given", "name[?use='text']", "code.a.b"]


@pytest.mark.parametrize("seed", range(14))
def test_any_order(spark, seed):
    r = random.Random(seed)
    writes = [(r.choice(SOURCES), r.choice(TARGETS)) for _ in range(r.randint(3, 6))]
    assert [shown(x) for x in compiled(spark, writes)] == [shown(plain(x, writes)) for x in RECORDS], writes
