"""The reference's only sample input (two CSV patients) against its CSV mapping seed."""

import json
import os

from pyspark.sql import functions as F

from weft.operators.map_in import map_in
from weft.plans.seeds import CSV_MAPPING
from weft.sinks import tagged
from weft.sources.records import read_csv_records

HERE = os.path.dirname(os.path.abspath(__file__))


def _run(spark):
    df = read_csv_records(spark, os.path.join(HERE, "fixtures", "patient.csv")).drop("_corrupt_record")
    return map_in(df, CSV_MAPPING, variant_col="record")


def test_patient_csv_golden(spark):
    plan = _run(spark)
    lines = [json.loads(r.line) for r in tagged(plan.df).collect()]
    data = [x for x in lines if x["type"] == "data"]
    errors = [x for x in lines if x["type"] == "error"]
    assert data == [{"type": "data", "item": {
        "resourceType": "Patient", "meta": {"profile": ["http://localhost:8080/fhir/StructureDefinition/1"]},
        "id": 2, "name": [{"text": "Maria Oliveira"}], "birthDate": "2025-04-27", "gender": "female"}}]
    assert len(errors) == 1
    errs = errors[0]["error"]["errors"]
    assert [e["fieldTargetPath"] for e in errs] == ["name[0].text", "birthDate"]
    assert errs[0]["message"] == "Value length (2) is less than minimum required (3)."
    assert errs[0]["inputValue"] == "Jo"
    assert errs[1]["message"] == "Formato esperado DD/MM/YYYY"
    assert errs[1]["details"]["type"] == "REGEX"
    assert errors[0]["error"]["originalItem"]["id_paciente"] == 1


def test_extra_patient_rows(spark, tmp_path):
    p = tmp_path / "more.csv"
    p.write_text("id_paciente,nome_completo,data_nascimento,genero,cpf\n"
                 "3,Ana Souza,31/02/2025,,01234567890\n"
                 "4,Rui Lima,1/4/2025,I,12345678901\n")
    df = read_csv_records(spark, str(p)).drop("_corrupt_record")
    out = {r.id: r for r in map_in(df, CSV_MAPPING, variant_col="record").df.select(
        F.try_variant_get("item.id", "$", "int").alias("id"), F.to_json("item").alias("j"), "errors").collect()}
    # 31/02 passes the regex but not the date parse; the leading-zero cpf became a number (7 digits short)
    msgs3 = [e.message for e in out[3].errors]
    assert "Failed to parse date '31/02/2025' with format 'dd/MM/yyyy'" in msgs3
    assert "CPF deve ter 11 dígitos" in msgs3
    # 1/4/2025 fails the two-digit regex; blank gender would become 'unknown'
    assert any(e.fieldTargetPath == "birthDate" for e in out[4].errors)


def test_fixture_edge_rows(spark, tmp_path):
    """FIXTURES §1 additions: blank gender (N1 → 'unknown'), blank id, short row,
    blank line, 11-digit cpf with and without a leading zero, 1/4/2025."""
    p = tmp_path / "edge.csv"
    p.write_text("id_paciente,nome_completo,data_nascimento,genero,cpf\n"
                 "5,Bia Costa,01/02/2000,,12345678901\n"
                 "\n"
                 ",Caio Reis,02/03/2001,M,\n"
                 "7,Davi Melo\n"
                 "8,Eva Nunes,1/4/2025,F,01234567890\n")
    df = read_csv_records(spark, str(p))
    rows = map_in(df, CSV_MAPPING, variant_col="record").df.select(
        F.to_json("item").alias("j"), "errors", "original").collect()
    assert len(rows) == 4  # the blank line is skipped
    by_name = {json.loads(r.j)["name"][0]["text"]: r for r in rows}
    bia = by_name["Bia Costa"]
    assert bia.errors == []
    item = json.loads(bia.j)
    assert item["gender"] == "unknown" and item["identifier"] == [{"value": 12345678901}]
    assert item["birthDate"] == "2000-02-01"
    caio = by_name["Caio Reis"]
    assert [(e.fieldTargetPath, e.message) for e in caio.errors] == [
        ("id", "Value is required but was missing or empty.")]
    davi = by_name["Davi Melo"]  # short row: missing cells are missing values
    assert davi.errors == [] and json.loads(davi.j)["gender"] == "unknown"
    eva = by_name["Eva Nunes"]
    assert [e.message for e in eva.errors] == ["Formato esperado DD/MM/YYYY", "CPF deve ter 11 dígitos"]
