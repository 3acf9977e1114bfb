"""Hand-derived cases per operator family on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from weft.operators.definitions import ingest
from weft.operators.map_in import map_in
from weft.operators.map_out import map_out
from weft.plans.config import Definition, Element, profile_from_definition
from weft.plans.seeds import JSON_PATIENT_MAPPING, PATIENT_TO_CSV, RACE_TARGET
from weft.sources.bundles import bundle_resources, next_link
from weft.sources.records import inline_records


def test_json_patient_nested_predicates(spark):
    recs = inline_records(spark, [{
        "pacienteIdInterno": "p1", "cpf": "12345678901", "nomeCompleto": "Ana", "dataNascimento": "02/03/1990",
        "sexo": "F", "statusAtivo": True, "contatos": [{"telefone": "555"}, {"email": "a@x"}], "codigoRacaCor": "01"}])
    plan = map_in(recs.drop("_corrupt_record"), JSON_PATIENT_MAPPING, variant_col="record")
    row = plan.df.select(F.to_json("item").alias("j"), "errors").first()
    item = json.loads(row.j)
    assert row.errors == []
    assert item["telecom"] == [{"value": "555"}, {"value": "a@x"}]
    assert item["birthDate"] == "1990-03-02"
    assert item["active"] is True
    ext = item["extension"][0]
    assert ext["url"].endswith("BRRacaCorEtnia-1.0")
    assert ext["extension"][0] == {"url": "race", "valueCodeableConcept": {"coding": [{"code": "01"}]}}
    assert RACE_TARGET.startswith("extension[?url=")


def test_auto_fill_and_mandatory(spark):
    d = Definition("http://x/sd", "Patient", (
        Element("Patient", 0, "*"),
        Element("Patient.identifier", 1, "*", ordinal=1),
        Element("Patient.identifier.system", 0, "1", fixed_value="urn:x", fixed_type="uri", ordinal=2),
        Element("Patient.active", 0, "1", default_value="true", default_type="boolean", ordinal=3),
        Element("Patient.gender", 1, "1", ordinal=4),
    ))
    from weft.plans.catalog import cfg, fm

    c = cfg("T", "Patient", fm(0, "v", "identifier[0].value"), fm(1, "g", "gender"), url="http://x/sd")
    df = spark.createDataFrame([("a", "male"), ("b", None)], "v string, g string")
    rows = map_in(df, c, profile_from_definition(d)).df.select(F.to_json("item").alias("j"), "errors").collect()
    first = json.loads(rows[0].j)
    assert first["identifier"] == [{"value": "a", "system": "urn:x"}]
    assert first["active"] is True and rows[0].errors == []
    assert [e.fieldTargetPath for e in rows[1].errors] == ["gender"]
    assert rows[1].errors[0].fieldSourcePath == "N/A (FHIR Profile Post-check)"


def test_map_out_csv_predicate_and_type_filter(spark):
    res = inline_records(spark, [
        {"resourceType": "Patient", "id": "1", "name": [{"text": "Ana"}], "gender": "female",
         "identifier": [{"system": "other", "value": "9"},
                        {"system": "urn:oid:2.16.840.1.113883.13.236", "value": "123"}]},
        {"resourceType": "Observation", "id": "2"}])
    out = map_out(res.drop("_corrupt_record"), PATIENT_TO_CSV, variant_col="record").df.collect()
    data = [r for r in out if not r.errors]
    err = [r for r in out if r.errors]
    assert json.loads(data[0].item.cpf.toJson()) == "123"
    assert err[0].errors[0].message == "Expected 'Patient', got 'Observation'. Skipping."


def test_ingest_rejects_and_dedupe(spark):
    docs = [
        {"resourceType": "StructureDefinition", "url": "u1", "type": "T",
         "snapshot": {"element": [{"path": "T"}, {"path": "T.a", "fixedBoolean": True}, {"path": "T.a"}, {"min": 1}]}},
        {"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "Patient"}}]},
        {"resourceType": "StructureDefinition", "type": "X"},
    ]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "t string").select(F.parse_json("t").alias("doc"))
    r = ingest(df)
    els = r.elements.orderBy("ordinal").collect()
    assert [(e.path, e.fixedValue, e.fixedValueType) for e in els] == [("T", None, None), ("T.a", "true", "boolean")]
    assert r.counts.first().elementCount == 3
    assert sorted(x.reason[:10] for x in r.rejects.collect()) == ["Bundle rec", "Document i"]


def test_bundle_scan(spark):
    pages = [{"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "Patient", "id": "a"}}, {"fullUrl": "x"}],
              "link": [{"relation": "next", "url": "p2"}]},
             {"resourceType": "Bundle", "link": [{"relation": "next", "url": "p3"}]},
             {"resourceType": "OperationOutcome"}]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(pages)], "i int, t string") \
        .select("i", F.parse_json("t").alias("page"))
    res = bundle_resources(df, keep=("i",)).collect()
    assert [(r.i, r.entry_pos) for r in res] == [(0, 0)]
    nxt = dict(df.select("i", next_link(F.col("page")).alias("n")).collect())
    assert nxt[0] == "p2"


def test_store_roundtrip_and_lookup(spark, tmp_path):
    from weft.operators.definitions import delete_elements, read_store, store
    from weft.plans.config import find_definition, resolve_profile
    from weft.plans.catalog import cfg, fm

    doc = {"resourceType": "StructureDefinition", "url": "http://x/p", "type": "Patient", "id": "p",
           "snapshot": {"element": [{"path": "Patient", "min": 0, "max": "*"},
                                    {"path": "Patient.gender", "min": 1, "max": "1"},
                                    {"path": "Patient.active", "defaultValueBoolean": False, "type": [{"code": "boolean"}]}]}}
    df = spark.createDataFrame([(json.dumps(doc),)], "t string").select(F.parse_json("t").alias("doc"))
    root = str(tmp_path / "store")
    store(ingest(df), root)
    defs, els = read_store(spark, root)
    d = find_definition(defs, els, "http://x/p", None)
    assert [e.path for e in d.elements] == ["Patient", "Patient.gender", "Patient.active"]
    prof = resolve_profile(spark, cfg("c", "Patient", fm(0, "g", "gender"), url="http://x/p"), defs, els)
    assert [e.path for e in prof.mandatory] == ["Patient.gender"]
    assert [e.path for e in prof.fill] == ["Patient.active"]
    delete_elements(defs.select(F.col("id").alias("structureDefinitionId")), root)
    assert read_store(spark, root)[1].count() == 0


def test_load_mapping_from_tables(spark):
    from weft.plans.config import FIELD_MAPPINGS_DDL, MAPPING_CONFIGURATIONS_DDL, MappingNotFound, load_mapping

    configs = spark.createDataFrame([("c1", "M", None, "JSON", "Patient", "TO_FHIR", None, None, None)],
                                    MAPPING_CONFIGURATIONS_DDL)
    fms = spark.createDataFrame([
        ("f2", "c1", 1, "b", "name[0].text", None, None, "MIN_LENGTH", '{"min": 2}', None, None, None),
        ("f1", "c1", 0, "a", "id", None, None, "REQUIRED", None, None, None, None)], FIELD_MAPPINGS_DDL)
    m = load_mapping(configs, fms, "M")
    assert [x.target_path for x in m.mappings] == ["id", "name[0].text"]
    assert m.mappings[1].validation_details == {"min": 2}
    try:
        load_mapping(configs, fms, "nope")
        raise AssertionError("expected MappingNotFound")
    except MappingNotFound:
        pass


def test_stream_and_sinks(spark, tmp_path):
    from weft.plans.seeds import OBSERVATION_MAPPING
    from weft.sinks import pretty_json, write_csv, write_split
    from weft.streaming import read_record_stream, start_map_in_stream

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text(
        '{"vitalSign":{"id":"o1","status":"final","value":72.5,"unit":"bpm"},"patientId":"Patient/1"}\n{"bad": \n')
    q = start_map_in_stream(read_record_stream(spark, str(src)), OBSERVATION_MAPPING, str(tmp_path / "out"),
                            str(tmp_path / "ck"), variant_col="record")
    q.awaitTermination()
    data = spark.read.text(str(tmp_path / "out" / "batch=0" / "type=data")).collect()
    errs = spark.read.text(str(tmp_path / "out" / "batch=0" / "type=error")).collect()
    assert json.loads(data[0].value)["item"]["valueQuantity"] == {"value": 72.5, "unit": "bpm"}
    assert json.loads(errs[0].value)["error"]["originalItem"] == '{"bad": '
    recs = inline_records(spark, [{"vitalSign": {"id": "o2", "status": "final"}, "patientId": "Patient/2"}])
    plan = map_in(recs, OBSERVATION_MAPPING, variant_col="record")
    write_split(plan.df, str(tmp_path / "split"))
    assert spark.read.text(str(tmp_path / "split" / "type=data")).count() == 1
    typed = spark.createDataFrame([("o3", "final")], "id string, st string")
    from weft.plans.catalog import cfg, fm

    p2 = map_in(typed, cfg("c", "Observation", fm(0, "id", "id"), fm(1, "st", "status"),
                          fm(2, "st", "code.coding[0].code")))
    write_csv(p2.df, str(tmp_path / "csv"))
    header = spark.read.option("header", True).csv(str(tmp_path / "csv")).columns
    assert header == ["resourceType", "id", "status", "code.coding"]
    txt = p2.df.select(pretty_json(F.col("item")).alias("p")).first().p
    assert json.loads(txt)["status"] == "final" and "\n" in txt


def test_fanout_padding_and_key_order(spark):
    from weft.plans.catalog import cfg, fm

    df = spark.createDataFrame([("Ana", "Lima"), (None, "Rocha")], "t string, f string")
    c = cfg("F", "Patient", fm(0, "t", "name[1].text"), fm(1, "f", "name.family"), fm(2, "f", "meta.profile[1]"))
    rows = [r.j for r in map_in(df, c).df.select(F.to_json("item").alias("j")).collect()]
    assert rows[0] == ('{"resourceType":"Patient","name":[{"family":"Lima"},{"text":"Ana","family":"Lima"}],'
                       '"meta":{"profile":[null,"Lima"]}}')
    assert rows[1] == '{"resourceType":"Patient","name":[{"family":"Rocha"}],"meta":{"profile":[null,"Rocha"]}}'


def test_mixed_index_then_filter(spark):
    import pytest

    from weft.plans.catalog import cfg, fm
    from weft.plans.tree import CompileError

    df = spark.createDataFrame([("111", "222"), (None, "333")], "cpf string, cns string")
    c = cfg("M", "Patient", fm(0, "cpf", "identifier[0].value"),
            fm(1, "cns", "identifier[?system='cns'].value"))
    rows = [r.j for r in map_in(df, c).df.select(F.to_json("item.identifier").alias("j")).collect()]
    assert rows == ['[{"value":"111"},{"system":"cns","value":"222"}]', '[{"system":"cns","value":"333"}]']
    assert CompileError and pytest  # index-after-filter is now replayed in order (see test below)


def test_filter_then_index_replayed_in_order(spark):
    from weft.plans.catalog import cfg, fm

    df = spark.createDataFrame([("111", "222"), (None, "333"), ("444", None)], "cns string, use string")
    c = cfg("Q", "Patient", fm(0, "cns", "identifier[?system='cns'].value"), fm(1, "use", "identifier[0].use"),
            fm(2, "use", "identifier[?system='cns'].period"), fm(3, "cns", "identifier.type"))
    rows = [json.loads(r.j) for r in map_in(df, c).df.select(F.to_json("item.identifier").alias("j")).collect()]
    # row 1: the filter creates element 0, [0] writes into it, the filter finds it again, fan-out
    assert rows[0] == [{"system": "cns", "value": "111", "use": "222", "period": "222", "type": "111"}]
    # row 2: no filter element, [0] creates a plain slot, the filter appends after it
    assert rows[1] == [{"use": "333"}, {"system": "cns", "period": "333"}]
    assert rows[2] == [{"system": "cns", "value": "444", "type": "444"}]


def test_push_with_injected_sender(spark):
    from weft.plans.catalog import cfg, fm
    from weft.sinks import push, push_plan

    df = spark.createDataFrame([("1", "Ana"), (None, "Bo")], "id string, n string")
    plan = push_plan(map_in(df, cfg("P", "Patient", fm(0, "id", "id"), fm(1, "n", "name[0].text"))).df,
                     "Patient", "http://fhir.test", "PUT")

    def sender(method, url, body):  # stands in for an HTTP client
        return (200 if method == "PUT" else 201), None

    out = sorted((r.method, r.url, r.status) for r in push(plan, sender).collect())
    assert out == [("POST", "http://fhir.test/Patient", 201), ("PUT", "http://fhir.test/Patient/1", 200)]


def test_failfast_reader(spark, tmp_path):
    import pytest

    from weft.sources.records import read_json_records

    p = tmp_path / "bad.json"
    p.write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        read_json_records(spark, str(p), on_malformed="fail").collect()
    rows = read_json_records(spark, str(p)).collect()  # (Spark refuses queries of the corrupt column alone)
    assert sum(r._corrupt_record is not None for r in rows) == 1


def test_default_value_explicit_null(spark):
    from weft.plans.catalog import cfg, fm

    df = spark.createDataFrame([("a",), (None,)], "s string")
    c = cfg("N", "Patient", fm(0, "s", "meta.status", None, None, "DEFAULT_VALUE", {"value": None}))
    rows = sorted(r.j for r in map_in(df, c).df.select(F.to_json("item").alias("j")).collect())
    assert rows == ['{"resourceType":"Patient","meta":{"status":"a"}}',
                    '{"resourceType":"Patient","meta":{"status":null}}']


def test_auto_fill_below_a_whole_value(spark):
    """A source array mapped as a whole, then a profile fixed value below it
    fans out over every element (row-dependent length); an object value is extended."""
    from weft.plans.catalog import cfg, fm

    d = Definition("http://x/sd2", "Patient", (
        Element("Patient", 0, "*"),
        Element("Patient.telecom", 0, "*", ordinal=1),
        Element("Patient.telecom.system", 0, "1", fixed_value="phone", fixed_type="code", ordinal=2),
        Element("Patient.maritalStatus.text", 0, "1", default_value="unknown", default_type="string", ordinal=3),
    ))
    df = spark.createDataFrame(
        [([("1",), ("2",)], ("M",)), ([], None), (None, ("S",))],
        "phones array<struct<value:string>>, ms struct<coding:string>")
    c = cfg("H", "Patient", fm(0, "phones", "telecom"), fm(1, "ms", "maritalStatus"), url="http://x/sd2")
    rows = [json.loads(r.j) for r in map_in(df, c, profile_from_definition(d)).df
            .select(F.to_json("item").alias("j")).collect()]
    assert rows[0]["telecom"] == [{"value": "1", "system": "phone"}, {"value": "2", "system": "phone"}]
    assert rows[0]["maritalStatus"] == {"coding": "M", "text": "unknown"}
    assert rows[1]["telecom"] == [{"system": "phone"}] and rows[1]["maritalStatus"] == {"text": "unknown"}
    assert rows[2]["telecom"] == [{"system": "phone"}] and rows[2]["maritalStatus"] == {"coding": "S", "text": "unknown"}


def test_scalar_replaced_by_container(spark):
    from weft.plans.catalog import cfg, fm

    df = spark.createDataFrame([("x", "t1"), ("y", None), (None, "t3")], "c string, t string")
    c = cfg("S", "Patient", fm(0, "c", "code"), fm(1, "t", "code.text"))
    rows = [json.loads(r.j)["code"] for r in map_in(df, c).df.select(F.to_json("item").alias("j")).collect()]
    assert rows == [{"text": "t1"}, "y", {"text": "t3"}]


def test_auto_fill_below_a_whole_variant_value(spark):
    from weft.plans.catalog import cfg, fm

    d = Definition("http://x/sd3", "Patient", (
        Element("Patient", 0, "*"),
        Element("Patient.telecom", 0, "*", ordinal=1),
        Element("Patient.telecom.system", 0, "1", fixed_value="phone", fixed_type="code", ordinal=2),
        Element("Patient.maritalStatus.text", 0, "1", default_value="unknown", default_type="string", ordinal=3),
    ))
    recs = inline_records(spark, [
        {"k": 1, "phones": [{"value": "1"}, {"value": "2"}], "ms": {"coding": "M"}},
        {"k": 2, "phones": [], "ms": "S"},
        {"k": 3}])
    c = cfg("HV", "Patient", fm(0, "k", "id"), fm(1, "phones", "telecom"), fm(2, "ms", "maritalStatus"),
            url="http://x/sd3")
    rows = {json.loads(r.j)["id"]: json.loads(r.j) for r in map_in(recs, c, profile_from_definition(d), variant_col="record")
            .df.select(F.to_json("item").alias("j")).collect()}
    assert rows[1]["telecom"] == [{"system": "phone", "value": "1"}, {"system": "phone", "value": "2"}]
    assert rows[1]["maritalStatus"] == {"coding": "M", "text": "unknown"}
    assert rows[2]["telecom"] == [{"system": "phone"}]
    assert rows[2]["maritalStatus"] == {"text": "unknown"}  # a scalar is replaced by the new object
    assert rows[3]["telecom"] == [{"system": "phone"}] and rows[3]["maritalStatus"] == {"text": "unknown"}


def test_whole_value_after_writes_below(spark):
    from weft.plans.catalog import cfg, fm

    df = spark.createDataFrame([("t1", "x"), ("t2", None)], "t string, c string")
    c = cfg("L", "Patient", fm(0, "t", "code.text"), fm(1, "c", "code"))
    rows = [json.loads(r.j)["code"] for r in map_in(df, c).df.select(F.to_json("item").alias("j")).collect()]
    assert rows == ["x", {"text": "t2"}]


@pytest.mark.parametrize(("writes", "expected"), [
    ([("obj", "code"), ("b", "code.coding[0].code")], {"code": {"text": "t", "coding": [{"code": "B"}]}}),
    ([("obj", "code"), ("b", "code.coding.code")], {"code": {"text": "t", "coding": [{"code": "B"}]}}),
    ([("a", "identifier[0].system"), ("b", "identifier[?system='A'].value")], {"identifier": [{"system": "A", "value": "B"}]}),
    ([("a", "identifier[0].system"), ("b", "identifier[?system='cpf'].value")], {"identifier": [{"system": "A"}, {"system": "cpf", "value": "B"}]}),
    ([("a", "identifier[?system='cpf'].value"), ("b", "identifier[0].type.coding[0].code")],
     {"identifier": [{"system": "cpf", "value": "A", "type": {"coding": [{"code": "B"}]}}]}),
    ([("a", "extension[0]"), ("b", "extension[1].url")], {"extension": ["A", {"url": "B"}]}),
    ([("b", "extension[2].url"), ("a", "extension[0]")], {"extension": ["A", {}, {"url": "B"}]}),
    ([("a", "extension[0]"), ("b", "extension.url")], {"extension": ["A"]}),
    ([("arr", "telecom"), ("b", "telecom[1].use")], {"telecom": [{"value": "v"}, {"use": "B"}]}),
    ([("arr", "telecom"), ("b", "telecom[?value='v'].use")], {"telecom": [{"value": "v", "use": "B"}]}),
    ([("missing", "telecom"), ("b", "telecom[?value='v'].use")], {"telecom": [{"value": "v", "use": "B"}]}),
    ([("a", "resourceType")], {"resourceType": "A"}),
])
def test_array_writes_in_any_order(spark, writes, expected):
    from weft.plans.catalog import cfg, fm

    df = spark.sql("SELECT 'A' AS a, 'B' AS b, named_struct('text', 't') AS obj, array(named_struct('value', 'v')) AS arr, cast(null AS array<struct<value:string>>) AS missing")
    r = map_in(df, cfg("W", "Observation", *[fm(i, s, t) for i, (s, t) in enumerate(writes)]), keep_original=False)
    got = json.loads(r.df.select(F.to_json("item").alias("j")).first().j)
    assert {k: v for k, v in got.items() if k != "resourceType" or k in expected} == expected


def test_code_tables_in_a_mapping(spark):
    """Typed and dynamic records; null, missing and repeated codes, an unknown table, mixed defaults."""
    from weft.operators.map_in import map_in
    from weft.plans.config import FieldMapping, MappingConfig
    from weft.sources.records import inline_records

    fms = (
        FieldMapping("k", "code", "CODE_LOOKUP", {"table": "t"}),
        FieldMapping("k", "other", "code_lookup", {"table": "t", "defaultValue": 5}),
        FieldMapping("k", "own", "CODE_LOOKUP", {"map": {"1": "one"}, "table": "t", "defaultValue": "d"}),
        FieldMapping("n", "none", "CODE_LOOKUP", {"table": "nowhere"}),
    )
    cfg = MappingConfig("c", "Basic", mappings=fms)
    codes = spark.createDataFrame([("1", "x"), ("1", "w"), ("true", "y"), (None, "z"), ("undefined", "u")], "code string, value string")
    recs = inline_records(spark, [{"k": 1}, {"k": "1"}, {"k": True}, {"k": None}, {"k": "q"}, {"k": 1, "n": "v"}])
    out = map_in(recs, cfg, variant_col="record", code_tables={"t": codes}).df.collect()
    got = {(json.loads(r.original)["k"] if r.original else "", len(r.errors)): [e.message for e in r.errors] for r in out}
    assert sum(not r.errors for r in out) == 0  # the unknown table is an error of each record
    assert got["q", 2] == ["Value 'q' not found in CODE_LOOKUP map and no defaultValue provided", "Code table 'nowhere' is not known to this run."]
    known = MappingConfig("c", "Basic", mappings=fms[:3])
    out = map_in(recs, known, variant_col="record", code_tables={"t": codes}).df
    rows = [(json.loads(r.i), len(r.errors)) for r in out.select(F.to_json("item").alias("i"), "errors").collect()]
    assert [i["code"] for i, n in rows if not n] == ["w", "w", "y", "u", "w"]
    assert [i["other"] for i, _ in rows] == ["w", "w", "y", "u", 5, "w"]
    assert [i["own"] for i, _ in rows] == ["one", "one", "d", "d", "d", "one"]


def test_many_configs_equal_their_own_runs(spark):
    """Dynamic records of several configs, null and unknown ones, malformed records, clashing columns."""
    from weft.operators.map_many import map_in_many
    from weft.plans.config import FieldMapping, MappingConfig
    from weft.sources.records import parse_json_column

    texts = ['{"c":"a b/é","x":1}', '{"c":"b","x":"2"}', '{"c":"z","x":3}', '{"x":4}', "oops", '{"c":"b"}', '{"c":"a b/é","x":{"y":[1]}}']
    recs = parse_json_column(spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, _config int"), "t", keep=("_config",))
    a = MappingConfig("a", "Basic", mappings=(FieldMapping("x", "code"),))
    b = MappingConfig("b", "Patient", mappings=(FieldMapping("x", "name[0].text", None, None, "REQUIRED"),))
    name = F.try_variant_get(F.col("record"), "$.c", "string")
    out = map_in_many(recs, name, {"a b/é": a, "b": b, "unused": a}, variant_col="record", keep=("_config",)).select("*", F.to_json("item").alias("j")).collect()
    got = {r._config: (r.config, r.j if not r.errors else None, [e.message for e in r.errors], r.original) for r in out}
    assert len(out) == len(texts)
    for cfg_, rows in ((a, (0, 6)), (b, (1, 5))):
        own = map_in(recs.where(F.col("_config").isin(*rows)), cfg_, variant_col="record", keep=("_config",)).df.select("*", F.to_json("item").alias("j")).collect()
        for r in own:
            config, j, messages, original = got[r._config]
            assert messages == [e.message for e in r.errors] and original == r.original
            assert (json.loads(j) if j else None) == (json.loads(r.j) if not r.errors else None)
    assert got[2][2] == ["Mapping configuration 'z' not found"] and json.loads(got[2][3]) == {"c": "z", "x": 3}
    assert got[3][2] == ["The record names no mapping configuration."] == got[4][2] and got[4][3] == "oops"
    assert map_in_many(recs.where("false"), name, {"a": a}, variant_col="record").collect() == []
