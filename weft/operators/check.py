"""Mapping check (J5, J6, J7, C7, C8, A3) as joins over the control tables.

Every configuration is checked against the newest definition matching its
url or resource type.  A config's mappings and a definition's elements, both as
many as one document holds, are gathered to arrays and meet in one row per
config, where each rule is an array expression:

* J5 path existence — a target yields up to five candidate keys (C7), one of
  which must be among the definition's relative paths (A3).
* J6 fixed-value conflict — of the elements that are the target's path or a
  slice of it, the first in document order wins.
* J7 mandatory coverage — an element needs a target that starts with its base path.

The result lists every violation with a ``rank``; ``rank = 1`` is the one
the reference would raise first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.coerce import stored_value_column
from weft.plans.config import latest_definitions


def path_candidates(p: Column) -> Column:
    """Keys a mapping target may match, in the order the rules try them.

    The target itself; without bracket groups; without its first slice name
    (``a:s.b`` gives ``a.b``, then ``a``); up to a slice name that ends it
    (``a.b:s`` gives ``a.b``).
    """
    simple = F.regexp_replace(p, r"\[.*?\]", "")
    colon = F.instr(simple, ":")
    owner = F.substring_index(simple, ":", 1)
    sliced = F.when(colon > 0, simple.substr(colon + 1, F.length(simple)))
    dot = F.instr(sliced, ".")
    below = dot > 1  # a slice name, then more of the path
    last = F.substring_index(simple, ".", -1)
    mark = F.instr(last, ":")
    ends = (mark > 0) & (mark < F.length(last))
    return F.array_compact(F.array(
        p,
        F.when(simple != p, simple),
        F.when(below, F.concat(owner, sliced.substr(dot, F.length(sliced)))),
        F.when(below, owner),
        F.when(ends, simple.substr(F.lit(1), F.length(simple) - F.length(last) + mark - 1)),
    ))


def _invalid(name: Column, what: Column, url: Column) -> Column:
    return F.concat(F.lit("Mapping '"), name, F.lit("' contains invalid FHIR path '"), what,
                    F.lit("' according to StructureDefinition '"), url, F.lit("'."))


def resolve_definitions(configs: DataFrame, definitions: DataFrame) -> DataFrame:
    """All configs with the newest definition of their url, else that of their
    type, else null (def_id, def_url).  Either side of both joins has a row per key."""
    latest = latest_definitions(definitions).select(
        F.col("id").alias("def_id"), F.col("url").alias("def_url"), F.col("type").alias("def_type"),
        F.col("processedAt").alias("def_at"))
    found = F.struct("def_id", "def_url")
    w_type = Window.partitionBy("def_type").orderBy(F.col("def_at").desc(), F.col("def_id").desc())
    by_type = latest.where(F.col("def_type").isNotNull()).withColumn("_rn", F.row_number().over(w_type)) \
        .where("_rn = 1").select(F.col("def_type").alias("rt"), found.alias("_t"))
    # merged, never broadcast: Spark takes derived tables for much smaller than they are.
    # The names of types are few
    by_url = latest.select(F.col("def_url").alias("sd_url"), found.alias("_u")).hint("merge")
    c = configs.select(F.col("id").alias("cfg_id"), F.col("name").alias("cfg_name"),
                       F.col("fhirResourceType").alias("rt"), F.col("direction"),
                       F.col("structureDefinitionUrl").alias("sd_url"))
    # Q4: an exact url match wins over a same-type profile
    d = F.coalesce("_u", "_t")
    return c.join(by_url, "sd_url", "left").join(F.broadcast(by_type), "rt", "left").select(
        *c.columns, d["def_id"].alias("def_id"), d["def_url"].alias("def_url"))


def check_mappings(configs: DataFrame, field_mappings: DataFrame, definitions: DataFrame,
                   elements: DataFrame) -> DataFrame:
    """All violations of all configs: cfg_id, cfg_name, phase, ordinal, kind, message, rank."""
    # what needs parsing is parsed per element and per mapping, before they are gathered
    fixed = stored_value_column(F.col("fixedValue"), F.coalesce(F.col("fixedValueType"), F.try_element_at("dataTypes", F.lit(1))))
    mandatory = (F.coalesce(F.col("cardinalityMin"), F.lit(0)) >= 1) & F.col("fixedValue").isNull() & F.col("defaultValue").isNull()
    els = elements.select(F.col("structureDefinitionId").alias("def_id"), F.struct(
        "ordinal", "path", F.col("fixedValue").isNotNull().alias("is_fixed"), fixed.alias("fixed"), mandatory.alias("mandatory")).alias("e"))
    els = els.groupBy("def_id").agg(F.sort_array(F.collect_list("e")).alias("els"))
    user = F.to_json(F.try_variant_get(F.try_parse_json(F.col("transformationDetails")), "$.value", "variant"))
    own = F.when(F.upper(F.col("transformationType")) == "DEFAULT_VALUE", user)
    fms = field_mappings.select(F.col("mappingConfigurationId").alias("cfg_id"), F.struct(
        "ordinal", F.col("targetFhirPath").alias("target"), path_candidates(F.col("targetFhirPath")).alias("cands"),
        F.split_part(F.col("targetFhirPath"), F.lit("["), F.lit(1)).alias("plain"), own.alias("own")).alias("m"))
    fms = fms.groupBy("cfg_id").agg(F.collect_list("m").alias("ms"))

    # a row per config with the elements of its definition and its mappings
    c = resolve_definitions(configs, definitions).join(els.hint("merge"), "def_id", "left").join(fms.hint("merge"), "cfg_id", "left")
    name, rt, def_url = F.col("cfg_name"), F.col("rt"), F.col("def_url")
    head = F.concat(rt, F.lit("."))
    none = F.array().cast("array<struct<phase:int,ordinal:int,place:int,kind:string,message:string>>")

    def relative(path: Column) -> Column:
        return F.when(path.startswith(head), path.substr(F.length(rt) + 2, F.length(path))).otherwise(path)

    def violation(phase: int, ordinal: Column, place: int, kind: str, message: Column) -> Column:
        return F.struct(F.lit(phase).alias("phase"), ordinal.cast("int").alias("ordinal"), F.lit(place).alias("place"),
                        F.lit(kind).alias("kind"), message.alias("message"))

    def path_of(m: Column) -> Column:
        return _invalid(name, F.concat(F.lit("Path '"), F.coalesce(m["target"], F.lit("")), F.lit("'")), def_url)

    ms = F.coalesce("ms", F.array().cast(fms.schema["ms"].dataType))
    c = c.select("*", F.transform("els", lambda e: relative(e["path"])).alias("rels"),  # A3
                 F.transform(F.filter(ms, lambda m: F.length(m["target"]) > 0), lambda m: m["target"]).alias("targets"))

    # J5 path existence
    bad_path = F.transform(F.filter(ms, lambda m: ~F.coalesce(F.arrays_overlap(m["cands"], F.col("rels")), F.lit(False))),
                           lambda m: violation(1, m["ordinal"], 0, "path", path_of(m)))

    # J6 fixed-value conflict: the first element that is the target's path, or a slice of it
    def first_element(m: Column) -> Column:
        full = F.concat(head, m["plain"])
        return F.get(F.filter("els", lambda e: (e["path"] == full) | e["path"].startswith(F.concat(full, F.lit(":")))), 0)

    conflicts = F.filter(F.transform(ms, lambda m: F.struct(m.alias("m"), first_element(m).alias("e"))),
                         lambda x: F.coalesce(x["e"]["is_fixed"], F.lit(False)) & ~F.coalesce(x["m"]["own"] == x["e"]["fixed"], F.lit(False)))
    bad_fixed = F.transform(conflicts, lambda x: violation(1, x["m"]["ordinal"], 1, "fixed", path_of(x["m"])))

    # J7 mandatory coverage (map-in only): a target starts with the element's base path
    def uncovered(e: Column) -> Column:
        rel = relative(e["path"])
        base = F.split_part(rel, F.lit("["), F.lit(1))
        return e["mandatory"] & (rel != "") & (e["path"] != rt) & ~F.exists("targets", lambda t: t.startswith(base))

    bad_mand = F.transform(F.filter("els", uncovered), lambda e: violation(
        2, e["ordinal"], 1, "mandatory", _invalid(name, F.concat(F.lit("Mandatory element '"), relative(e["path"]), F.lit("'")), def_url)))
    bad_mand = F.when(F.col("direction") == "TO_FHIR", bad_mand).otherwise(none)

    # no definition (or one without elements): one violation, nothing else is checked
    url, type_ = F.expr("nullif(sd_url, '')"), F.expr("nullif(rt, '')")
    no_message = F.coalesce(
        F.concat(F.lit("Required StructureDefinition '"), F.coalesce(url, F.concat(F.lit("type '"), type_, F.lit("'"))),
                 F.lit("' has not been processed or was not found in the database.")),
        F.concat(F.lit("Mapping configuration '"), name,
                 F.lit("' is incomplete for validation (missing structureDefinitionUrl and fhirResourceType).")))
    no_def = F.array(F.when(url.isNull() & type_.isNull(), violation(0, F.lit(0), 0, "incomplete", no_message))
                     .otherwise(violation(0, F.lit(0), 0, "definition", no_message)))

    # path violations of a mapping come before its fixed-value violation
    every = F.when(F.col("els").isNull(), no_def).otherwise(F.array_sort(F.concat(bad_path, bad_fixed, bad_mand)))
    ranked = c.select("cfg_id", "cfg_name", F.posexplode(every).alias("_at", "v"))
    return ranked.select("cfg_id", "cfg_name", "v.phase", "v.ordinal", "v.kind", "v.message", (F.col("_at") + 1).alias("rank"))
