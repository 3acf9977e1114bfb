"""The mapping check on small control tables, rule by rule, and the choice of a url's document in an ingest."""

from pyspark.sql import functions as F

from weft.operators.check import check_mappings
from weft.operators.definitions import ingest

CONFIGS = "id string, name string, fhirResourceType string, direction string, structureDefinitionUrl string"
MAPPINGS = "mappingConfigurationId string, ordinal int, targetFhirPath string, transformationType string, transformationDetails string"
DEFS = "id string, url string, type string, processedAt timestamp"
ELS = ("structureDefinitionId string, ordinal int, path string, cardinalityMin int, fixedValue string, fixedValueType string, "
       "defaultValue string, dataTypes array<string>")


def check(spark, configs, mappings, els):
    defs = spark.createDataFrame([("d0", "u", "T", None), ("d1", "v", "T", None), ("bare", "w", "B", None)], DEFS)
    defs = defs.withColumn("processedAt", F.when(F.col("id") == "d0", F.lit("2025-01-01")).otherwise(F.lit("2025-02-01")).cast("timestamp"))
    out = check_mappings(spark.createDataFrame(configs, CONFIGS), spark.createDataFrame(mappings, MAPPINGS), defs, spark.createDataFrame(els, ELS))
    return sorted((r.cfg_id, r["rank"], r.kind, r.phase, r.ordinal, r.message) for r in out.collect())


def el(d, n, path, least=0, fixed=None, kind=None, default=None):
    return (d, n, path, least, fixed, kind, default, ["string"])


ELS_OF = [
    el("d0", 0, "T"), el("d0", 1, "T.code:main", 1, "x", "string"), el("d0", 2, "T.code", 1), el("d0", 3, "T.name", 1), el("d0", 4, "T.note", 1, default="n"),
    el("d1", 0, "T"), el("d1", 1, "T.title", 1),
]


def kinds(found):
    return [(c, rank, kind, phase, n) for c, rank, kind, phase, n, _ in found]


def test_rules_and_their_order(spark):
    found = check(spark, [("a", "A", "T", "TO_FHIR", "u")], [
        ("a", 0, "nope", None, None), ("a", 1, "code[0].x", None, None), ("a", 2, "code:main", "DEFAULT_VALUE", '{"value":"x"}'),
        ("a", 3, None, None, None), ("a", 3, "name", None, None), ("a", 4, "code", "default_value", '{"value":"y"}')], ELS_OF)
    # the first element that is T.code or a slice of it is the fixed one, also for the plain code
    assert kinds(found) == [("a", 1, "path", 1, 0), ("a", 2, "path", 1, 1), ("a", 3, "fixed", 1, 1), ("a", 4, "path", 1, 3), ("a", 5, "fixed", 1, 4)]
    assert found[0][5] == "Mapping 'A' contains invalid FHIR path 'Path 'nope'' according to StructureDefinition 'u'."


def test_mandatory_only_for_map_in_and_no_mappings(spark):
    found = check(spark, [("a", "A", "T", "TO_FHIR", "u"), ("b", "B", "T", "FROM_FHIR", "u")], [], ELS_OF)
    assert kinds(found) == [("a", 1, "mandatory", 2, 2), ("a", 2, "mandatory", 2, 3)]


def test_newest_of_the_type_where_the_url_is_unknown(spark):
    found = check(spark, [("a", "A", "T", "TO_FHIR", "other")], [("a", 0, "title", None, None)], ELS_OF)
    assert found == []
    found = check(spark, [("a", "A", "T", "TO_FHIR", None)], [("a", 0, "name", None, None)], ELS_OF)
    assert kinds(found) == [("a", 1, "path", 1, 0), ("a", 2, "mandatory", 2, 1)]


def test_without_a_definition_nothing_else_is_checked(spark):
    found = check(spark, [("a", "A", "B", "TO_FHIR", "w"), ("b", "B", "Z", "TO_FHIR", ""), ("c", "C", None, "TO_FHIR", "")],
                  [("a", 0, "x", None, None), ("b", 0, "x", None, None), ("c", 0, "x", None, None)], ELS_OF)
    assert kinds(found) == [("a", 1, "definition", 0, 0), ("b", 1, "definition", 0, 0), ("c", 1, "incomplete", 0, 0)]
    assert "'w'" in found[0][5] and "type 'Z'" in found[1][5]


def test_last_document_of_a_url_wins_whole(spark):
    docs = ['{"resourceType":"StructureDefinition","url":"u","name":"one","snapshot":{"element":[{"path":"T"},{"path":"T.old"}]}}',
            '{"resourceType":"Bundle","entry":[{"resource":{"resourceType":"StructureDefinition","url":"u","name":"two","snapshot":{"element":null},"differential":{"element":[{"path":"T"},{"path":"T"}]}}},{"resource":{}}]}',
            '{"resourceType":"StructureDefinition","url":"e","snapshot":{"element":[]},"differential":{"element":[{"path":"T"}]}}',
            '{"resourceType":"Bundle","entry":[]}', '{"resourceType":"StructureDefinition","url":"n","snapshot":{"element":[]}}', "[1]", "null"]
    r = ingest(spark.createDataFrame([(d,) for d in docs], "t string").coalesce(1).select(F.parse_json("t").alias("doc")))
    assert [(x.url, x.name) for x in r.definitions.collect()] == [("u", "two")]
    assert [(x.path, x.ordinal) for x in r.elements.collect()] == [("T", 0)]
    assert [x.reason.split(" ")[0] for x in r.rejects.orderBy("doc_pos").collect()] == ["StructureDefinition", "Bundle", "StructureDefinition", "Unexpected", "Unexpected"]
