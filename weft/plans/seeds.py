"""Sample mapping configurations (the reference's seed data, retyped as fixtures)."""

from __future__ import annotations

from weft.plans.config import FROM_FHIR, TO_FHIR, FieldMapping, MappingConfig

# Seed URLs and mapping rows.
PATIENT_PROFILE_URL = "http://localhost:8080/fhir/StructureDefinition/1"
OBSERVATION_URL = "http://hl7.org/fhir/StructureDefinition/Observation"
GENDER_VS = "http://hl7.org/fhir/ValueSet/administrative-gender"
GENDER_MAP = {"map": {"M": "male", "F": "female", "I": "other"}, "defaultValue": "unknown"}
RACE_TARGET = (
    "extension[?url='http://www.saude.gov.br/fhir/r4/StructureDefinition/BRRacaCorEtnia-1.0']"
    ".extension[?url='race'].valueCodeableConcept.coding[0].code"
)


def _fm(i, src, tgt, vt=None, vd=None, tt=None, td=None):
    return FieldMapping(src, tgt, tt, td, vt, vd, ordinal=i)


CSV_MAPPING = MappingConfig(
    name="CsvMapping", resource_type="Patient", direction=TO_FHIR, source_type="CSV",
    definition_url=PATIENT_PROFILE_URL,
    mappings=(
        _fm(0, "id_paciente", "id", "REQUIRED"),
        _fm(1, "nome_completo", "name[0].text", "MIN_LENGTH", {"min": 3}),
        _fm(2, "data_nascimento", "birthDate", "REGEX",
            {"pattern": "^\\d{2}/\\d{2}/\\d{4}$", "message": "Formato esperado DD/MM/YYYY"},
            "FORMAT_DATE", {"inputFormat": "dd/MM/yyyy", "outputFormat": "yyyy-MM-dd"}),
        _fm(3, "genero", "gender", "VALUESET", {"valueSetUrl": GENDER_VS, "strength": "required"},
            "CODE_LOOKUP", GENDER_MAP),
        _fm(4, "cpf", "identifier[0].value", "REGEX",
            {"pattern": "^\\d{11}$", "message": "CPF deve ter 11 dígitos"}),
    ),
)

JSON_PATIENT_MAPPING = MappingConfig(
    name="ExampleJsonToPatient", resource_type="Patient", direction=TO_FHIR, source_type="JSON",
    definition_url=PATIENT_PROFILE_URL,
    mappings=(
        _fm(0, "pacienteIdInterno", "id", "REQUIRED"),
        _fm(1, "cpf", "identifier[0].value", "REGEX",
            {"pattern": "^\\d{11}$", "message": "CPF deve ter 11 dígitos numéricos"}),
        _fm(2, "nomeCompleto", "name[0].text", "REQUIRED"),
        _fm(3, "dataNascimento", "birthDate", "REGEX", {"pattern": "^\\d{2}/\\d{2}/\\d{4}$"},
            "FORMAT_DATE", {"inputFormat": "dd/MM/yyyy", "outputFormat": "yyyy-MM-dd"}),
        _fm(4, "sexo", "gender", "VALUESET", {"valueSetUrl": GENDER_VS}, "CODE_LOOKUP", GENDER_MAP),
        _fm(5, "statusAtivo", "active"),
        _fm(6, "contatos[0].telefone", "telecom[0].value"),
        _fm(7, "contatos[1].email", "telecom[1].value"),
        _fm(8, "codigoRacaCor", RACE_TARGET),
    ),
)

OBSERVATION_MAPPING = MappingConfig(
    name="JsonToObservationVitals", resource_type="Observation", direction=TO_FHIR, source_type="JSON",
    definition_url=OBSERVATION_URL,
    mappings=tuple(
        _fm(i, s, t)
        for i, (s, t) in enumerate(
            [
                ("vitalSign.id", "id"), ("vitalSign.status", "status"),
                ("vitalSign.code", "code.coding[0].code"), ("vitalSign.display", "code.coding[0].display"),
                ("vitalSign.codeSystem", "code.coding[0].system"), ("vitalSign.value", "valueQuantity.value"),
                ("vitalSign.unit", "valueQuantity.unit"), ("vitalSign.valueSystem", "valueQuantity.system"),
                ("vitalSign.effectiveDateTime", "effectiveDateTime"), ("patientId", "subject.reference"),
            ]
        )
    ),
)

PATIENT_TO_CSV = MappingConfig(
    name="PatientToCsvBasic", resource_type="Patient", direction=FROM_FHIR, source_type="CSV",
    definition_url=PATIENT_PROFILE_URL,
    mappings=(
        _fm(0, "patient_identifier", "id", "REQUIRED"),
        _fm(1, "full_name", "name[0].text", "MIN_LENGTH", {"min": 3}),
        _fm(2, "dob", "birthDate"),
        _fm(3, "sex", "gender"),
        _fm(4, "cpf", "identifier[?system='urn:oid:2.16.840.1.113883.13.236'].value"),
    ),
)

OBSERVATION_TO_JSON = MappingConfig(
    name="ObservationToJsonBasic", resource_type="Observation", direction=FROM_FHIR, source_type="JSON",
    definition_url=OBSERVATION_URL,
    mappings=tuple(
        _fm(i, s, t)
        for i, (t, s) in enumerate(
            [
                ("id", "obsId"), ("status", "currentStatus"), ("code.coding[0].code", "measurement.code"),
                ("code.coding[0].display", "measurement.name"), ("valueQuantity.value", "result.value"),
                ("valueQuantity.unit", "result.units"), ("effectiveDateTime", "timestamp"),
                ("subject.reference", "patientRef"),
            ]
        )
    ),
)
