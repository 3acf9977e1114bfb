"""Plans of the definition store and the mapping check: what grows is neither broadcast nor read or sorted in one task."""

import re

from weft.operators.definitions import ingest
from weft.plans import catalog

SF = "/root/testdata/sf0.1"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_check_broadcasts_types_alone(spark):
    assert len(re.findall("BroadcastExchange", plan_of(catalog._violations(spark, SF)))) == 1


def test_store_and_lookup_joins_broadcast_nothing(spark):
    for name in ("definition_ingest", "definition_dedupe", "definition_filters", "identifier_resolution"):
        assert "Broadcast" not in plan_of(catalog.QUERIES[name](spark, SF)), name


def test_an_ingest_stored_twice_reads_its_documents_once(spark, tmp_path):
    from weft.operators import definitions as d

    r = d.written(ingest(catalog.part_documents(spark, "/root/testdata/sf0.001")))
    assert "parse_json" not in plan_of(r.elements) + plan_of(r.definitions)
    assert d.store(r, str(tmp_path)) == d.store(r, str(tmp_path))
    defs, els = d.read_store(spark, str(tmp_path))
    assert (defs.count(), els.count()) == (r.definitions.count(), r.elements.count())


def test_documents_of_a_small_file_are_made_by_many_tasks(spark):
    assert catalog.part_documents(spark, SF).rdd.getNumPartitions() == 4
    assert catalog.part_documents(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 1


def test_documents_are_dealt_before_the_choice_and_headers_without_them(spark):
    docs = catalog.part_documents(spark, SF)
    r = ingest(docs)
    for df in (r.definitions, r.elements):
        assert "REPARTITION_BY_NUM" in plan_of(df).split("WindowGroupLimit")[-1], "sorted where documents are read"
    sort = next(line for line in r.definitions._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression [url" in line)
    assert sort  # what lies below goes through the shuffle
    below = r.definitions._jdf.queryExecution().optimizedPlan().toString().split(sort)[1].strip().splitlines()[0]
    assert "sd#" not in below.split("Project")[-1]
