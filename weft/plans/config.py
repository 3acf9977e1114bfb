"""Configuration model (S6, J1, F7) and profile model (definitions).

Configs and profiles are *control data*: a mapping has tens of fields and a
profile a few hundred elements, independent of the data volume.  They are read
from Spark tables with a filter on the unique key and collected to the driver
once per job, where the compiler turns them into Column expressions.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TO_FHIR = "TO_FHIR"
FROM_FHIR = "FROM_FHIR"

# Spark DDL of the control tables.
MAPPING_CONFIGURATIONS_DDL = (
    "id STRING, name STRING, description STRING, sourceType STRING, fhirResourceType STRING, "
    "direction STRING, structureDefinitionUrl STRING, createdAt TIMESTAMP, updatedAt TIMESTAMP"
)
FIELD_MAPPINGS_DDL = (
    "id STRING, mappingConfigurationId STRING, ordinal INT, sourcePath STRING, targetFhirPath STRING, "
    "transformationType STRING, transformationDetails STRING, validationType STRING, "
    "validationDetails STRING, defaultValue STRING, createdAt TIMESTAMP, updatedAt TIMESTAMP"
)
DEFINITIONS_DDL = (
    "id STRING, url STRING, version STRING, name STRING, type STRING, fhirVersion STRING, "
    "description STRING, processedAt TIMESTAMP"
)
DEFINITION_ELEMENTS_DDL = (
    "id STRING, structureDefinitionId STRING, ordinal INT, path STRING, sliceName STRING, "
    "shortDescription STRING, definition STRING, dataTypes ARRAY<STRING>, cardinalityMin INT, "
    "cardinalityMax STRING, fixedValue STRING, fixedValueType STRING, defaultValue STRING, "
    "defaultValueType STRING"
)


class MappingNotFound(LookupError):
    pass


@dataclass(frozen=True)
class FieldMapping:
    source_path: str | None
    target_path: str | None
    transformation_type: str | None = None
    transformation_details: Any = None
    validation_type: str | None = None
    validation_details: Any = None
    default_value: Any = None
    ordinal: int = 0

    @property
    def transformation(self) -> str | None:
        return self.transformation_type.upper() if self.transformation_type else None

    def details_json(self, which: str) -> str | None:
        d = self.transformation_details if which == "transformation" else self.validation_details
        return None if d is None else json.dumps(d, separators=(",", ":"), ensure_ascii=False)


@dataclass(frozen=True)
class MappingConfig:
    name: str
    resource_type: str
    direction: str = TO_FHIR
    source_type: str = "JSON"
    definition_url: str | None = None
    mappings: tuple[FieldMapping, ...] = ()
    description: str | None = None


@dataclass(frozen=True)
class Element:
    path: str
    min: int | None = 0
    max: str | None = None
    fixed_value: str | None = None
    fixed_type: str | None = None
    default_value: str | None = None
    default_type: str | None = None
    data_types: tuple[str, ...] = ()
    slice_name: str | None = None
    ordinal: int = 0


@dataclass(frozen=True)
class Definition:
    url: str
    type: str | None
    elements: tuple[Element, ...] = field(default_factory=tuple)


def _json_or_none(text: str | None) -> Any:
    if text is None:
        return None
    try:
        return json.loads(text)
    except ValueError:
        return text


def load_mapping(configs: DataFrame, field_mappings: DataFrame, name: str) -> MappingConfig:
    """S6 + J1: one config by unique name with its field mappings in ordinal order."""
    cfg = configs.where(F.col("name") == F.lit(name)).limit(2).collect()
    if not cfg:
        raise MappingNotFound(f"Mapping configuration '{name}' not found")
    c = cfg[0]
    rows = (
        field_mappings.where(F.col("mappingConfigurationId") == F.lit(c["id"]))
        .orderBy("ordinal", "id")
        .collect()
    )
    fms = tuple(
        FieldMapping(
            source_path=r["sourcePath"],
            target_path=r["targetFhirPath"],
            transformation_type=r["transformationType"],
            transformation_details=_json_or_none(r["transformationDetails"]),
            validation_type=r["validationType"],
            validation_details=_json_or_none(r["validationDetails"]),
            default_value=r["defaultValue"],
            ordinal=r["ordinal"] if r["ordinal"] is not None else i,
        )
        for i, r in enumerate(rows)
    )
    return MappingConfig(
        name=c["name"],
        resource_type=c["fhirResourceType"],
        direction=c["direction"] or TO_FHIR,
        source_type=c["sourceType"] or "JSON",
        definition_url=c["structureDefinitionUrl"],
        mappings=fms,
        description=c["description"],
    )


def latest_definitions(definitions: DataFrame) -> DataFrame:
    """Newest row per url (ties broken by id so the pick is deterministic)."""
    w = Window.partitionBy("url").orderBy(F.col("processedAt").desc(), F.col("id").desc())
    return definitions.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def find_definition(
    definitions: DataFrame,
    elements: DataFrame,
    url: str | None = None,
    type_: str | None = None,
    element_filter=None,
) -> Definition | None:
    """F5 + W1 + J2: newest definition whose url or type matches (neither given →
    none), with its elements in document order, optionally filtered (F4)."""
    conds = []
    if url:
        conds.append(F.col("url") == F.lit(url))
    if type_:
        conds.append(F.col("type") == F.lit(type_))
    if not conds:
        return None
    cond = conds[0]
    for c in conds[1:]:
        cond = cond | c
    # Q4: an exact url match wins over another profile of the same type, then the newest
    pref = F.when(F.col("url") == F.lit(url), 0).otherwise(1) if url else F.lit(1)
    head = (
        latest_definitions(definitions)
        .where(cond)
        .orderBy(pref, F.col("processedAt").desc(), F.col("id").desc())
        .limit(1)
        .collect()
    )
    if not head:
        return None
    h = head[0]
    els = elements.where(F.col("structureDefinitionId") == F.lit(h["id"]))
    if element_filter is not None:
        els = els.where(element_filter)
    rows = els.orderBy("ordinal").collect()
    return Definition(
        url=h["url"],
        type=h["type"],
        elements=tuple(
            Element(
                path=r["path"], min=r["cardinalityMin"], max=r["cardinalityMax"],
                fixed_value=r["fixedValue"], fixed_type=r["fixedValueType"],
                default_value=r["defaultValue"], default_type=r["defaultValueType"],
                data_types=tuple(r["dataTypes"] or ()), slice_name=r["sliceName"],
                ordinal=r["ordinal"] or 0,
            )
            for r in rows
        ),
    )


def mandatory_filter():
    """elements with min >= 1."""
    return F.col("cardinalityMin") >= 1


def fixed_or_default_filter():
    """elements carrying a fixed or default value."""
    return F.col("fixedValue").isNotNull() | F.col("defaultValue").isNotNull()


@dataclass(frozen=True)
class Profile:
    """The three element lists a map-in run consults (J3, hoisted out of the row loop).

    * ``complete``  — container choice (P12): newest definition by url OR type;
    * ``fill``      — auto-fill (R1): elements with a fixed/default value;
    * ``mandatory`` — mandatory check (R2): elements with min >= 1.
    ``fill``/``mandatory`` are looked up by url only, with the url falling back
    to the type name when no url is configured (so with no url they usually
    find nothing, as in the reference).
    """

    complete: tuple[Element, ...] = ()
    fill: tuple[Element, ...] = ()
    mandatory: tuple[Element, ...] = ()


def resolve_profile(spark: SparkSession | None, cfg: MappingConfig, definitions: DataFrame | None,
                    elements: DataFrame | None) -> Profile:
    if definitions is None or elements is None:
        return Profile()
    full = find_definition(definitions, elements, cfg.definition_url, cfg.resource_type)
    if full is None or not full.elements:
        return Profile(complete=full.elements if full else ())
    ident = cfg.definition_url or cfg.resource_type
    fill = find_definition(definitions, elements, ident, None, fixed_or_default_filter())
    mand = find_definition(definitions, elements, ident, None, mandatory_filter())
    return Profile(
        complete=full.elements,
        fill=fill.elements if fill else (),
        mandatory=mand.elements if mand else (),
    )


def profile_from_definition(d: Definition | None) -> Profile:
    """Profile when the caller already holds the definition (no tables)."""
    if d is None or not d.elements:
        return Profile()
    return Profile(
        complete=d.elements,
        fill=tuple(e for e in d.elements if e.fixed_value is not None or e.default_value is not None),
        mandatory=tuple(e for e in d.elements if (e.min or 0) >= 1),
    )
