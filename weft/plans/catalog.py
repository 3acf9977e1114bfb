"""Query catalogue over the driver's test tables.

Each entry runs one operator family of the library over whole tables (or
data Spark derives from them) and projects flat scalar columns, so the
result can be compared with an independent SQL statement (``SQL``) that
encodes the reference's semantics directly.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.validations import extended_validations
from weft.operators.lookup import code_lookup_table
from weft.operators.map_in import map_in
from weft.plans.config import FieldMapping, MappingConfig

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return deco


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fm(i, src, tgt, vt=None, vd=None, tt=None, td=None) -> FieldMapping:
    return FieldMapping(src, tgt, tt, td, vt, vd, ordinal=i)


def cfg(name: str, rt: str, *mappings: FieldMapping, url: str | None = None, source_type: str = "JSON",
        direction: str = "TO_FHIR") -> MappingConfig:
    return MappingConfig(name=name, resource_type=rt, direction=direction, source_type=source_type,
                         definition_url=url, mappings=tuple(mappings))


# --------------------------------------------------------------------------- map-in

SEGMENT_GENDER = {"map": {"AUTOMOBILE": "male", "BUILDING": "female", "FURNITURE": "other"}, "defaultValue": "unknown"}
CUSTOMER_TO_PATIENT = cfg(
    "CustomerToPatient", "Patient",
    fm(0, "c_custkey", "id", "REQUIRED"),
    fm(1, "c_name", "name[0].text", "MIN_LENGTH", {"min": 3}),
    fm(2, "c_mktsegment", "gender", None, None, "CODE_LOOKUP", SEGMENT_GENDER),
)
GENDER_SQL = ("CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'male' WHEN 'BUILDING' THEN 'female' "
              "WHEN 'FURNITURE' THEN 'other' ELSE 'unknown' END")


def customer_patients(spark: SparkSession, sf: str, keep_original: bool = False):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return map_in(c, CUSTOMER_TO_PATIENT, keep=("c_custkey",), keep_original=keep_original)


def _patient_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "c_custkey", F.col("item.id").alias("id"), F.get("item.name", 0)["text"].alias("name_text"),
        F.col("item.gender").alias("gender"), F.size("errors").alias("n_errors"))


@register("map_in_customer", f"""
SELECT c_custkey, c_custkey AS id, c_name AS name_text, {GENDER_SQL} AS gender,
       CAST(CASE WHEN length(c_name) < 3 THEN 1 ELSE 0 END AS INTEGER) AS n_errors
FROM customer""")
def q_map_in_customer(spark, sf):
    return _patient_columns(customer_patients(spark, sf).df)


@register("map_in_json", f"""
SELECT c_custkey,
  '{{"resourceType":"Patient","id":' || c_custkey || ',"name":[{{"text":' || CAST(to_json(c_name) AS VARCHAR)
  || '}}],"gender":' || CAST(to_json({GENDER_SQL}) AS VARCHAR) || '}}' AS resource_json
FROM customer""")
def q_map_in_json(spark, sf):
    return customer_patients(spark, sf).df.select("c_custkey", F.to_json("item").alias("resource_json"))


ORDER_CHECKS = cfg(
    "OrderChecks", "Encounter",
    fm(0, "o_orderkey", "id", "REQUIRED"),
    fm(1, "status_np", "status", "REQUIRED"),
    fm(2, "o_orderpriority", "priority.text", "REGEX", {"pattern": "^[1-3]-"}),
    fm(3, "o_custkey", "subject.reference", "MIN_LENGTH", {"min": 4}),
)
ORDER_ERRORS_CTE = """
WITH e AS (
  SELECT o_orderkey, 1 AS ord, 'status_np' AS source, 'status' AS target, 'Validation' AS error_type,
         'Value is required but was missing or empty.' AS message, CAST(NULL AS VARCHAR) AS input_value
  FROM orders WHERE o_orderstatus = 'P'
  UNION ALL
  SELECT o_orderkey, 2, 'o_orderpriority', 'priority.text', 'Validation',
         'Value ''' || o_orderpriority || ''' does not match pattern /^[1-3]-/.', CAST(to_json(o_orderpriority) AS VARCHAR)
  FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-')
  UNION ALL
  SELECT o_orderkey, 3, 'o_custkey', 'subject.reference', 'Validation',
         'Value length (' || length(CAST(o_custkey AS VARCHAR)) || ') is less than minimum required (4).',
         CAST(o_custkey AS VARCHAR)
  FROM orders WHERE length(CAST(o_custkey AS VARCHAR)) < 4
)"""


def order_checks(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status_np"), "o_orderpriority", "o_custkey")
    return map_in(o, ORDER_CHECKS, keep=("o_orderkey",), keep_original=False)


@register("map_in_errors", ORDER_ERRORS_CTE + """
SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY ord) AS INTEGER) AS err_pos,
       source, target, error_type, message, input_value
FROM e""")
def q_map_in_errors(spark, sf):
    p = order_checks(spark, sf)
    return p.df.select("o_orderkey", F.posexplode("errors").alias("pos", "e")).select(
        "o_orderkey", (F.col("pos") + 1).cast("int").alias("err_pos"),
        F.col("e.fieldSourcePath").alias("source"), F.col("e.fieldTargetPath").alias("target"),
        F.col("e.errorType").alias("error_type"), F.col("e.message").alias("message"),
        F.col("e.inputValue").alias("input_value"))


@register("error_gate_counts", ORDER_ERRORS_CTE + """
, flags AS (SELECT o.o_orderkey, EXISTS (SELECT 1 FROM e WHERE e.o_orderkey = o.o_orderkey) AS bad FROM orders o)
SELECT CASE WHEN bad THEN 'error' ELSE 'data' END AS bucket, count(*) AS n FROM flags GROUP BY 1
UNION ALL
SELECT error_type || ':' || target AS bucket, count(*) AS n FROM e GROUP BY 1""")
def q_error_gate_counts(spark, sf):
    from weft.sinks import error_summary

    df = order_checks(spark, sf).df
    rows = df.select(F.when(F.size("errors") == 0, "data").otherwise("error").alias("bucket")) \
        .groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    by = error_summary(df).select(F.concat("errorType", F.lit(":"), "fieldTargetPath").alias("bucket"), "n")
    return rows.unionByName(by)


# --------------------------------------------------------------------------- transformations

DATE_REGEX = {"pattern": "^\\d{2}/\\d{2}/\\d{4}$"}
DATE_FMT = {"inputFormat": "dd/MM/yyyy", "outputFormat": "yyyy-MM-dd"}


@register("format_date", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS value, CAST(NULL AS VARCHAR) AS message FROM orders""")
def q_format_date(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("d"))
    c = cfg("Dates", "Encounter", fm(0, "d", "period.start", "REGEX", DATE_REGEX, "FORMAT_DATE", DATE_FMT))
    p = map_in(o, c, keep=("o_orderkey",), keep_original=False)
    return p.df.select("o_orderkey", F.col("item.period.start").alias("value"),
                       F.get("errors", 0)["message"].alias("message"))


@register("format_date_invalid", """
SELECT o_orderkey,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value,
  CASE WHEN o_orderstatus = 'P'
       THEN 'Failed to parse date ''31/02/' || strftime(o_orderdate, '%Y') || ''' with format ''dd/MM/yyyy''' END AS message
FROM orders""")
def q_format_date_invalid(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("31/02/"), F.date_format("o_orderdate", "yyyy")))
        .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("d"))
    c = cfg("BadDates", "Encounter", fm(0, "d", "period.start", None, None, "FORMAT_DATE", DATE_FMT))
    p = map_in(o, c, keep=("o_orderkey",), keep_original=False)
    return p.df.select("o_orderkey", F.col("item.period.start").alias("value"),
                       F.get("errors", 0)["message"].alias("message"))


@register("string_case", """
SELECT p_partkey, upper(p_name) AS name, lower(p_brand) AS brand FROM part""")
def q_string_case(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    c = cfg("Case", "Device",
            fm(0, "p_name", "deviceName", None, None, "STRING_CASE", {"case": "UPPER"}),
            fm(1, "p_brand", "manufacturer", None, None, "STRING_CASE", {"case": "lower"}))
    r = map_in(p, c, keep=("p_partkey",), keep_original=False)
    return r.df.select("p_partkey", F.col("item.deviceName").alias("name"), F.col("item.manufacturer").alias("brand"))


@register("default_value", """
SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status FROM orders""")
def q_default_value(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("s"))
    c = cfg("Default", "Encounter", fm(0, "s", "status", None, None, "DEFAULT_VALUE", {"value": "pending"}))
    r = map_in(o, c, keep=("o_orderkey",), keep_original=False)
    return r.df.select("o_orderkey", F.col("item.status").alias("status"))


SEGMENT_CODES = {"AUTOMOBILE": "car", "BUILDING": "house", "FURNITURE": "home", "HOUSEHOLD": "home", "MACHINERY": "plant"}


@register("code_lookup_map", """
SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'car' WHEN 'BUILDING' THEN 'house'
  WHEN 'FURNITURE' THEN 'home' WHEN 'HOUSEHOLD' THEN 'home' WHEN 'MACHINERY' THEN 'plant' END AS code
FROM customer""")
def q_code_lookup_map(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    m = cfg("Lookup", "Organization", fm(0, "c_mktsegment", "type.text", None, None, "CODE_LOOKUP", {"map": SEGMENT_CODES}))
    r = map_in(c, m, keep=("c_custkey",), keep_original=False)
    return r.df.select("c_custkey", F.col("item.type.text").alias("code"))


@register("code_lookup_join", """
SELECT s.s_suppkey, coalesce(n.n_name, 'unknown') AS nation
FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey""")
def q_code_lookup_join(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf, "nation")
    return code_lookup_table(s, "s_nationkey", n, "n_nationkey", "n_name", "nation", default="unknown") \
        .select("s_suppkey", "nation")


@register("code_lookup_missing", """
SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'car' WHEN 'BUILDING' THEN 'house' END AS code,
  CASE WHEN c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING')
       THEN 'Value ''' || c_mktsegment || ''' not found in CODE_LOOKUP map and no defaultValue provided' END AS message
FROM customer""")
def q_code_lookup_missing(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    m = cfg("LookupMissing", "Organization", fm(0, "c_mktsegment", "type.text", None, None, "CODE_LOOKUP",
                                                {"map": {"AUTOMOBILE": "car", "BUILDING": "house"}}))
    r = map_in(c, m, keep=("c_custkey",), keep_original=False)
    return r.df.select("c_custkey", F.col("item.type.text").alias("code"), F.get("errors", 0)["message"].alias("message"))


@register("concatenate", """
SELECT c_custkey, c_name || ' | ' || CAST(c_custkey AS VARCHAR) || ' | ' || coalesce(nullif(c_mktsegment, 'BUILDING'), '') AS label
FROM customer""")
def q_concatenate(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name",
                                            F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("seg"))
    m = cfg("Concat", "Patient", fm(0, "c_name", "name[0].text", None, None, "CONCATENATE",
                                    {"fieldsToConcat": ["c_name", "c_custkey", "seg"], "separator": " | "}))
    r = map_in(c, m, keep=("c_custkey",), keep_original=False)
    return r.df.select("c_custkey", F.get("item.name", 0)["text"].alias("label"))


# --------------------------------------------------------------------------- validations


def _validate(spark, sf, tname, key, col, vtype, details, extended=False):
    t = table(spark, sf, tname).select(key, col)
    m = cfg("Validate", "Basic", fm(0, col, "code.text", vtype, details))
    with extended_validations() if extended else nullcontext():
        r = map_in(t, m, keep=(key,), keep_original=False)  # compiled here
    return r.df.select(key, F.get("errors", 0)["message"].alias("message"))


@register("validate_regex", """
SELECT page_id, CASE WHEN NOT regexp_matches(url, '^https://')
  THEN 'Value ''' || url || ''' does not match pattern /^https:///.' END AS message FROM pages""")
def q_validate_regex(spark, sf):
    return _validate(spark, sf, "pages", "page_id", "url", "REGEX", {"pattern": "^https://"})


@register("validate_min_length", """
SELECT doc_id, CASE WHEN length(lang) < 3
  THEN 'Value length (' || length(lang) || ') is less than minimum required (3).' END AS message FROM documents""")
def q_validate_min_length(spark, sf):
    return _validate(spark, sf, "documents", "doc_id", "lang", "MIN_LENGTH", {"min": 3})


BLANK_SQL = "'^[\\t\\n\\x{0B}\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]*$'"


@register("validate_required", f"""
SELECT doc_id, CASE WHEN lang = 'de' OR text IS NULL OR regexp_matches(text, {BLANK_SQL})
  THEN 'Value is required but was missing or empty.' END AS message FROM documents""")
def q_validate_required(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("lang") == "de", F.lit(" \t ")).otherwise(F.col("text")).alias("text"))
    m = cfg("Required", "DocumentReference", fm(0, "text", "description", "REQUIRED"))
    r = map_in(d, m, keep=("doc_id",), keep_original=False)
    return r.df.select("doc_id", F.get("errors", 0)["message"].alias("message"))


@register("validate_valueset", """
SELECT doc_id, CAST(NULL AS VARCHAR) AS with_url,
  CASE WHEN source IS NOT NULL AND NOT regexp_matches(source, {blank})
       THEN 'Configuration error: Missing ValueSet URL.' END AS without_url
FROM documents""".replace("{blank}", BLANK_SQL))
def q_validate_valueset(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    a = map_in(d, cfg("VS1", "Basic", fm(0, "source", "code.text", "VALUESET", {"valueSetUrl": "http://x/vs"})),
               keep=("doc_id",), keep_original=False).df.select("doc_id", F.get("errors", 0)["message"].alias("with_url"))
    b = map_in(d, cfg("VS2", "Basic", fm(0, "source", "code.text", "VALUESET", {"strength": "required"})),
               keep=("doc_id",), keep_original=False).df.select("doc_id", F.get("errors", 0)["message"].alias("without_url"))
    return a.join(b, "doc_id")


@register("validate_valueset_members", """
WITH s AS (SELECT DISTINCT p_brand AS code FROM part WHERE p_size % 7 = 0)
SELECT p_partkey, CASE WHEN p_brand IS NOT NULL AND NOT regexp_matches(p_brand, {blank}) AND code IS NULL
    THEN 'Value ''' || p_brand || ''' is not valid according to ValueSet ''http://x/brands''.' END AS brand_message,
  CASE WHEN p_size > 25 THEN 'Value ''' || p_size || ''' is not valid according to ValueSet ''http://x/sizes''.' END AS size_message
FROM part LEFT JOIN s ON p_brand = code""".replace("{blank}", BLANK_SQL))
def q_validate_valueset_members(spark, sf):
    """V4 against a table of sets: texts and numbers, codes that come often, a set that the table doesn't have."""
    p = table(spark, sf, "part")
    brands = p.where("p_size % 7 = 0").select(F.lit("http://x/brands").alias("url"), F.col("p_brand").alias("code"))
    sizes = p.where("p_size <= 25").select(F.lit("http://x/sizes"), F.col("p_size").cast("string"))
    m = cfg("PartSets", "Device",
            fm(0, "p_brand", "manufacturer", "VALUESET", {"valueSetUrl": "http://x/brands", "strength": "required"}),
            fm(1, "p_size", "size", "VALUESET", {"valueSetUrl": "http://x/sizes"}),
            fm(2, "p_type", "type.text", "VALUESET", {"valueSetUrl": "http://x/unknown"}))
    r = map_in(p.select("p_partkey", "p_brand", "p_size", "p_type"), m, keep=("p_partkey",), keep_original=False, value_sets=brands.union(sizes)).df
    message = lambda c: F.get(F.filter("errors", lambda e: e["fieldSourcePath"] == c), 0)["message"]
    return r.select("p_partkey", message("p_brand").alias("brand_message"), message("p_size").alias("size_message"))


@register("validate_max_length", """
SELECT page_id, CASE WHEN length(url) > 40
  THEN 'Value length (' || length(url) || ') exceeds maximum allowed (40).' END AS message FROM pages""")
def q_validate_max_length(spark, sf):
    return _validate(spark, sf, "pages", "page_id", "url", "MAX_LENGTH", {"max": 40}, extended=True)


@register("unknown_function", """
SELECT o_orderkey, 'Validation function ''ENUM'' not registered.' AS msg1,
  'Transformation function ''TRIM'' not registered.' AS msg2, CAST(2 AS INTEGER) AS n_errors FROM orders""")
def q_unknown_function(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    m = cfg("Unknown", "Encounter",
            fm(0, "o_orderpriority", "priority.text", "ENUM", {"values": ["1-URGENT"]}),
            fm(1, "o_orderstatus", "status", None, None, "TRIM", None))
    r = map_in(o, m, keep=("o_orderkey",), keep_original=False)
    return r.df.select("o_orderkey", F.get("errors", 0)["message"].alias("msg1"),
                       F.get("errors", 1)["message"].alias("msg2"), F.size("errors").alias("n_errors"))


# --------------------------------------------------------------------------- path reads


@register("path_property_variant", """
SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events""")
def q_path_property_variant(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.try_parse_json("props").alias("record"))
    r = map_in(e, cfg("Props", "Observation", fm(0, "k", "valueInteger")), variant_col="record",
               keep=("event_id",), keep_original=False)
    return r.df.select("event_id", F.to_json(F.col("item.valueInteger")).alias("k"))


@register("path_index", """
SELECT p_partkey, str_split(p_name, ' ')[2] AS second_word,
  CASE WHEN len(str_split(p_name, ' ')) >= 6 THEN str_split(p_name, ' ')[6] END AS sixth_word FROM part""")
def q_path_index(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    r = map_in(p, cfg("Index", "Device", fm(0, "words[1]", "type.text"), fm(1, "words[5]", "model")),
               keep=("p_partkey",), keep_original=False)
    sixth = F.col("item.model") if "model" in r.item_type.fieldNames() else F.lit(None).cast("string")
    return r.df.select("p_partkey", F.col("item.type.text").alias("second_word"), sixth.alias("sixth_word"))


@register("path_first_element", """
SELECT conv_id, turn, role AS first_role FROM conversations""")
def q_path_first_element(spark, sf):
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.parse_json(F.to_json(F.struct(F.array(
            F.struct(F.col("role").alias("role"), F.col("turn").alias("turn")),
            F.struct(F.lit("system").alias("role"), F.lit(0).cast("bigint").alias("turn"))).alias("turns")))).alias("record"))
    r = map_in(c, cfg("First", "Communication", fm(0, "turns.role", "category.text")), variant_col="record",
               keep=("conv_id", "turn"), keep_original=False)
    return r.df.select("conv_id", "turn", F.try_variant_get(F.col("item.category.text"), "$", "string").alias("first_role"))


@register("path_default", """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN text ELSE '(none)' END AS v FROM conversations""")
def q_path_default(spark, sf):
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.parse_json(F.to_json(F.struct(F.when(F.col("role") == "user", F.struct(F.col("text").alias("b")))
                                        .alias("a")))).alias("record"))
    m = cfg("Default", "Communication", fm(0, "a.b", "payload.contentString", None, None, "DEFAULT_VALUE", {"value": "(none)"}))
    r = map_in(c, m, variant_col="record", keep=("conv_id", "turn"), keep_original=False)
    v = F.col("item.payload.contentString")
    return r.df.select("conv_id", "turn", F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(None)).alias("v"))


@register("path_predicate", """
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN text ELSE 'fallback' END AS text FROM conversations""")
def q_path_predicate(spark, sf):
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.array(F.struct(F.col("role").alias("role"), F.col("text").alias("text")),
                F.struct(F.lit("assistant").alias("role"), F.lit("fallback").alias("text"))).alias("turns"))
    r = map_in(c, cfg("Pred", "Communication", fm(0, "turns[?role='assistant'].text", "payload.contentString")),
               keep=("conv_id", "turn"), keep_original=False)
    return r.df.select("conv_id", "turn", F.col("item.payload.contentString").alias("text"))


@register("path_root", """
SELECT s_suppkey, '{"s_suppkey":' || s_suppkey || ',"s_name":' || CAST(to_json(s_name) AS VARCHAR)
  || ',"s_nationkey":' || s_nationkey || '}' AS root_json FROM supplier""")
def q_path_root(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    r = map_in(s, cfg("Root", "Basic", fm(0, "$ROOT", "source")), keep=("s_suppkey",), keep_original=False)
    return r.df.select("s_suppkey", F.to_json(F.col("item.source")).alias("root_json"))


# --------------------------------------------------------------------------- writes (tree shapes)


@register("set_index_padding", """
SELECT c_custkey,
  '[{},{"value":' || CAST(to_json(c_name) AS VARCHAR) || '}]' AS telecom_json,
  '[null,' || CAST(to_json(c_mktsegment) AS VARCHAR) || ']' AS profile_json
FROM customer""")
def q_set_index_padding(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    m = cfg("Padding", "Patient", fm(0, "c_name", "telecom[1].value"), fm(1, "c_mktsegment", "meta.profile[1]"))
    r = map_in(c, m, keep=("c_custkey",), keep_original=False)
    return r.df.select("c_custkey", F.to_json("item.telecom").alias("telecom_json"),
                       F.to_json("item.meta.profile").alias("profile_json"))


@register("set_predicate", """
SELECT c_custkey,
  '[{"url":"name","valueString":' || CAST(to_json(c_name) AS VARCHAR) || '}'
  || CASE WHEN c_mktsegment = 'BUILDING' THEN ''
          ELSE ',{"url":"segment","valueString":' || CAST(to_json(c_mktsegment) AS VARCHAR) || '}' END
  || ']' AS extension_json
FROM customer""")
def q_set_predicate(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name",
                                            F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("seg"))
    m = cfg("Predicate", "Patient", fm(0, "c_name", "extension[?url='name'].valueString"),
            fm(1, "seg", "extension[?url='segment'].valueString"))
    r = map_in(c, m, keep=("c_custkey",), keep_original=False)
    return r.df.select("c_custkey", F.to_json("item.extension").alias("extension_json"))


@register("set_fanout", """
SELECT c_custkey,
  CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 2 END AS INTEGER) AS n_names,
  c_mktsegment AS family0,
  CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_name END AS text1,
  CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS family1
FROM customer""")
def q_set_fanout(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")).alias("nm"), "c_mktsegment")
    m = cfg("Fanout", "Patient", fm(0, "nm", "name[1].text"), fm(1, "c_mktsegment", "name.family"))
    r = map_in(c, m, keep=("c_custkey",), keep_original=False)
    n = F.col("item.name")
    return r.df.select("c_custkey", F.size(n).alias("n_names"), F.get(n, 0)["family"].alias("family0"),
                       F.get(n, 1)["text"].alias("text1"), F.get(n, 1)["family"].alias("family1"))


def _container_profile():
    from weft.plans.config import Definition, Element, profile_from_definition

    d = Definition("http://example.org/sd/patient", "Patient", (
        Element("Patient", 0, "*", ordinal=0),
        Element("Patient.address", 0, "*", ordinal=1),
        Element("Patient.maritalStatus", 0, "1", ordinal=2),
    ))
    return profile_from_definition(d)


@register("set_container", """
SELECT c_custkey,
  '[{"city":' || CAST(to_json(c_name) AS VARCHAR) || '}]' AS address_json,
  '{"text":' || CAST(to_json(c_mktsegment) AS VARCHAR) || '}' AS marital_json,
  '{"0":{"title":' || c_custkey || '}}' AS photo_json
FROM customer""")
def q_set_container(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    m = cfg("Container", "Patient", fm(0, "c_name", "address.city"), fm(1, "c_mktsegment", "maritalStatus.text"),
            fm(2, "c_custkey", "photo[0].title"))
    r = map_in(c, m, _container_profile(), keep=("c_custkey",), keep_original=False)
    return r.df.select("c_custkey", F.to_json("item.address").alias("address_json"),
                       F.to_json("item.maritalStatus").alias("marital_json"), F.to_json("item.photo").alias("photo_json"))


# --------------------------------------------------------------------------- map-out


def _patients_as_resources(spark, sf):
    return customer_patients(spark, sf).df.select("c_custkey", "item.*")


PATIENT_TO_JSON = cfg("PatientToJson", "Patient", fm(0, "patient.key", "id"), fm(1, "patient.names[0]", "name[0].text"),
                      fm(2, "sex", "gender"), direction="FROM_FHIR")
PATIENT_TO_CSV = cfg("PatientToCsv", "Patient", fm(0, "full_name", "name[0].text"), fm(1, "segment.code", "gender"),
                     fm(2, "key", "id"), source_type="CSV", direction="FROM_FHIR")


@register("map_out_json", f"""
SELECT c_custkey, '{{"patient":{{"key":' || c_custkey || ',"names":[' || CAST(to_json(c_name) AS VARCHAR)
  || ']}},"sex":' || CAST(to_json({GENDER_SQL}) AS VARCHAR) || '}}' AS out_json
FROM customer""")
def q_map_out_json(spark, sf):
    from weft.operators.map_out import map_out

    r = map_out(_patients_as_resources(spark, sf), PATIENT_TO_JSON, keep=("c_custkey",), keep_original=False)
    return r.df.select("c_custkey", F.to_json("item").alias("out_json"))


@register("map_out_csv", f"""
SELECT c_custkey, c_name AS full_name, {GENDER_SQL} AS segment, c_custkey AS key FROM customer""")
def q_map_out_csv(spark, sf):
    from weft.operators.map_out import map_out

    r = map_out(_patients_as_resources(spark, sf), PATIENT_TO_CSV, keep=("c_custkey",), keep_original=False)
    return r.df.select("c_custkey", F.col("item.full_name").alias("full_name"), F.col("item.segment").alias("segment"),
                       F.col("item.key").alias("key"))


@register("drop_empty_output", """
SELECT c_custkey AS id, c_mktsegment AS sex FROM customer WHERE c_mktsegment <> 'BUILDING'""")
def q_drop_empty_output(spark, sf):
    from weft.operators.map_out import map_out

    res = table(spark, sf, "customer").select(
        F.lit("Patient").alias("resourceType"), F.col("c_custkey").alias("id"),
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("gender"))
    r = map_out(res, cfg("OnlySex", "Patient", fm(0, "sex", "gender"), direction="FROM_FHIR"), keep=("id",),
                keep_original=False)
    return r.df.select("id", F.col("item.sex").alias("sex"))


@register("resource_type_filter", """
SELECT event_id,
  CAST(CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS INTEGER) AS n_errors,
  CASE WHEN event_type <> 'purchase' THEN 'Expected ''purchase'', got ''' || event_type || '''. Skipping.' END AS message,
  CASE WHEN event_type = 'purchase' THEN event_id END AS eid
FROM events""")
def q_resource_type_filter(spark, sf):
    from weft.operators.map_out import map_out

    res = table(spark, sf, "events").select(F.col("event_type").alias("resourceType"), "event_id")
    r = map_out(res, cfg("Purchases", "purchase", fm(0, "eid", "event_id"), direction="FROM_FHIR"),
                keep=("event_id",), keep_original=False)
    return r.df.select("event_id", F.size("errors").alias("n_errors"), F.get("errors", 0)["message"].alias("message"),
                       F.col("item.eid").alias("eid"))


# --------------------------------------------------------------------------- profile-driven completion


def _encounter_profile(order: str = "check"):
    from weft.plans.config import Definition, Element, profile_from_definition

    els = [
        Element("Encounter", 0, "*", ordinal=0),
        Element("Encounter.status", 1, "1", default_value="finished", default_type="code", data_types=("code",), ordinal=1),
        Element("Encounter.class", 1, "1", data_types=("Coding",), ordinal=2),
        Element("Encounter.class.system", 0, "1", fixed_value="http://terminology.hl7.org/CodeSystem/v3-ActCode",
                fixed_type="uri", data_types=("uri",), ordinal=3),
        Element("Encounter.length.value", 0, "1", fixed_value="30", fixed_type="integer", data_types=("decimal",), ordinal=4),
        Element("Encounter.serviceType", 0, "1", fixed_value='{"text":"order"}', data_types=("CodeableConcept",), ordinal=5),
        Element("Encounter.priority.text", 0, "1", default_value="routine", data_types=("string",), ordinal=6),
    ]
    if order == "check":
        els += [Element("Encounter.subject", 1, "1", ordinal=7), Element("Encounter.subject.reference", 1, "1", ordinal=8),
                Element("Encounter.period.start", 1, "1", ordinal=9)]
    elif order == "suppress":
        els += [Element("Encounter.subject.reference", 1, "1", ordinal=7), Element("Encounter.subject", 1, "1", ordinal=8)]
    return profile_from_definition(Definition("http://example.org/sd/encounter", "Encounter", tuple(els)))


ENCOUNTER_FILL = cfg("EncounterFill", "Encounter", fm(0, "o_orderkey", "id"), fm(1, "s", "status"),
                     fm(2, "o_orderpriority", "class.code"), url="http://example.org/sd/encounter")


@register("auto_fill", """
SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'finished') AS status,
  '{"code":' || CAST(to_json(o_orderpriority) AS VARCHAR)
  || ',"system":"http://terminology.hl7.org/CodeSystem/v3-ActCode"}' AS class_json,
  '{"value":30}' AS length_json, '{"text":"order"}' AS service_json, 'routine' AS priority_text,
  CAST(0 AS INTEGER) AS n_errors
FROM orders""")
def q_auto_fill(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("s"),
                                          "o_orderpriority")
    r = map_in(o, ENCOUNTER_FILL, _encounter_profile("fill"), keep=("o_orderkey",), keep_original=False)
    return r.df.select("o_orderkey", F.col("item.status").alias("status"), F.to_json("item.class").alias("class_json"),
                       F.to_json("item.length").alias("length_json"), F.to_json("item.serviceType").alias("service_json"),
                       F.col("item.priority.text").alias("priority_text"), F.size("errors").alias("n_errors"))


def _mandatory(spark, sf, order):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("s"), "o_orderpriority",
        F.when(F.col("o_orderstatus") != "F", F.col("o_custkey").cast("string")).alias("cust"),
        F.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("start"))
    m = cfg("EncounterCheck", "Encounter", fm(0, "o_orderkey", "id"), fm(1, "s", "status"),
            fm(2, "o_orderpriority", "class.code"), fm(3, "cust", "subject.reference"), fm(4, "start", "period.start"),
            url="http://example.org/sd/encounter")
    r = map_in(o, m, _encounter_profile(order), keep=("o_orderkey",), keep_original=False)
    return r.df.select("o_orderkey", F.posexplode("errors").alias("pos", "e")).select(
        "o_orderkey", (F.col("pos") + 1).cast("int").alias("err_pos"), F.col("e.fieldSourcePath").alias("source"),
        F.col("e.fieldTargetPath").alias("target"), F.col("e.inputValue").alias("input_value"),
        F.col("e.message").alias("message"), F.col("e.details").alias("details"))


def _mand_sql(rows: list[tuple[int, str, str]]) -> str:
    parts = []
    for ordn, target, cond in rows:
        parts.append(
            f"SELECT o_orderkey, {ordn} AS ord, '{target}' AS target FROM orders WHERE {cond}")
    return ("WITH e AS (" + " UNION ALL ".join(parts) + ")\n"
            "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY ord) AS INTEGER) AS err_pos,\n"
            "  'N/A (FHIR Profile Post-check)' AS source, target, '\"undefined\"' AS input_value,\n"
            "  'Mandatory FHIR element ''' || target || ''' (min: 1) is missing, null, or an empty array in the final resource.' AS message,\n"
            "  '{\"rule\":\"cardinalityMin: 1\"}' AS details FROM e")


@register("mandatory_check", _mand_sql([
    (1, "subject", "o_orderstatus = 'F'"), (2, "subject.reference", "o_orderstatus = 'F'"),
    (3, "period.start", "o_orderstatus <> 'O'")]))
def q_mandatory_check(spark, sf):
    return _mandatory(spark, sf, "check")


@register("mandatory_suppression", _mand_sql([(1, "subject.reference", "o_orderstatus = 'F'")]))
def q_mandatory_suppression(spark, sf):
    return _mandatory(spark, sf, "suppress")


# --------------------------------------------------------------------------- profiles (documents derived from `part`)

PART_URL = "'http://example.org/sd/part-' || p_partkey"
_EL_FIELDS = ("path string, min int, max string, short string, type array<struct<code:string>>, fixedString string, "
              "defaultValueCode string, fixedInteger int, fixedCodeableConcept struct<text:string>")


def _el(path=None, mn=None, mx=None, short=None, types=None, fixed_string=None, default_code=None, fixed_int=None,
        fixed_cc=None):
    def c(v, t):
        if v is None:
            return F.lit(None).cast(t)
        return v.cast(t) if hasattr(v, "cast") else F.lit(v).cast(t)

    ty = (F.array(*[F.struct(F.lit(t).alias("code")) for t in types]) if types is not None
          else F.lit(None).cast("array<struct<code:string>>"))
    return F.struct(c(path, "string").alias("path"), c(mn, "int").alias("min"), c(mx, "string").alias("max"),
                    c(short, "string").alias("short"), ty.alias("type"), c(fixed_string, "string").alias("fixedString"),
                    c(default_code, "string").alias("defaultValueCode"), c(fixed_int, "int").alias("fixedInteger"),
                    (fixed_cc if fixed_cc is not None else F.lit(None).cast("struct<text:string>")).alias("fixedCodeableConcept"))


def _dealt_parts(spark, sf) -> DataFrame:
    """All part rows, dealt to tasks of about 5,000: the file is small, what is derived from its rows is not."""
    p = table(spark, sf, "part")
    tasks = -(-p.count() // 5_000)
    return p.repartition(tasks, "p_partkey") if tasks > 1 else p


def part_documents(spark, sf, names=None) -> DataFrame:
    """One profile document per part row (bare, or wrapped in a Bundle for even sizes;
    differential instead of snapshot above size 40)."""
    p = _dealt_parts(spark, sf)
    size = F.col("p_size")
    elements = F.array(
        _el("Part", 0, "*"),
        _el("Part.name", 1, "1", types=["string"], fixed_string=F.col("p_name")),
        _el("Part.brand", 0, "1", types=["code"], default_code=F.col("p_brand")),
        _el("Part.size", F.when(size > 25, 1).otherwise(0), "1", types=["integer"], fixed_int=size),
        _el("Part.name", 0, "1"),
        _el(None, 1),
        _el("Part.type", 0, "1", short=F.col("p_type"), types=["CodeableConcept", ""],
            fixed_cc=F.struct(F.col("p_type").alias("text"))),
        _el("Part.status", 1, "1", types=["code"]),
    )
    name = names if names is not None else F.col("p_name")
    sd = F.struct(
        F.lit("StructureDefinition").alias("resourceType"), F.concat(F.lit("part-"), F.col("p_partkey")).alias("id"),
        F.concat(F.lit("http://example.org/sd/part-"), F.col("p_partkey")).alias("url"), name.alias("name"),
        F.lit("Part").alias("type"), size.cast("string").alias("version"),
        F.when(size <= 40, F.struct(elements.alias("element"))).alias("snapshot"),
        F.when(size > 40, F.struct(elements.alias("element"))).alias("differential"))
    bundle = F.struct(F.lit("Bundle").alias("resourceType"), F.array(F.struct(sd.alias("resource"))).alias("entry"))
    text = F.when(size % 2 == 0, F.to_json(bundle)).otherwise(F.to_json(sd))
    return p.select("p_partkey", "p_size", F.parse_json(text).alias("doc"))


def _ingested(spark, sf):
    from datetime import datetime

    from weft.operators.definitions import ingest

    return ingest(part_documents(spark, sf), processed_at=F.lit(datetime(2025, 1, 1)).cast("timestamp"))


EXPECTED_ELEMENTS = f"""
WITH el AS (
  SELECT {PART_URL} AS url, 0 AS ordinal, 'Part' AS path, 0 AS card_min, '*' AS card_max, NULL AS fixed_value,
         NULL AS fixed_type, NULL AS default_value, NULL AS default_type, '' AS data_types FROM part
  UNION ALL SELECT {PART_URL}, 1, 'Part.name', 1, '1', p_name, 'string', NULL, NULL, 'string' FROM part
  UNION ALL SELECT {PART_URL}, 2, 'Part.brand', 0, '1', NULL, NULL, p_brand, 'code', 'code' FROM part
  UNION ALL SELECT {PART_URL}, 3, 'Part.size', CASE WHEN p_size > 25 THEN 1 ELSE 0 END, '1', CAST(p_size AS VARCHAR),
                   'integer', NULL, NULL, 'integer' FROM part
  UNION ALL SELECT {PART_URL}, 6, 'Part.type', 0, '1', '{{"text":' || CAST(to_json(p_type) AS VARCHAR) || '}}',
                   'codeableconcept', NULL, NULL, 'CodeableConcept' FROM part
  UNION ALL SELECT {PART_URL}, 7, 'Part.status', 1, '1', NULL, NULL, NULL, NULL, 'code' FROM part
)"""


@register("definition_ingest", EXPECTED_ELEMENTS + """
SELECT url, CAST(ordinal AS INTEGER) AS ordinal, path, CAST(card_min AS INTEGER) AS card_min, card_max,
       fixed_value, fixed_type, default_value, default_type, data_types FROM el""")
def q_definition_ingest(spark, sf):
    r = _ingested(spark, sf)
    h = r.definitions.select(F.col("id").alias("structureDefinitionId"), "url")
    return r.elements.join(h.hint("merge"), "structureDefinitionId").select(
        "url", "ordinal", "path", F.col("cardinalityMin").alias("card_min"), F.col("cardinalityMax").alias("card_max"),
        F.col("fixedValue").alias("fixed_value"), F.col("fixedValueType").alias("fixed_type"),
        F.col("defaultValue").alias("default_value"), F.col("defaultValueType").alias("default_type"),
        F.array_join("dataTypes", ",").alias("data_types"))


@register("definition_dedupe", f"""
SELECT {PART_URL} AS url, CAST(7 AS BIGINT) AS element_count, CAST(6 AS BIGINT) AS stored_count FROM part""")
def q_definition_dedupe(spark, sf):
    r = _ingested(spark, sf)
    stored = r.elements.groupBy("structureDefinitionId").agg(F.count(F.lit(1)).alias("stored_count"))
    return r.counts.join(stored.hint("merge"), "structureDefinitionId").select(
        "url", F.col("elementCount").alias("element_count"), "stored_count")


@register("definition_latest", f"""
SELECT {PART_URL} AS url, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS name,
       CAST(CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS INTEGER) AS version_no FROM part""")
def q_definition_latest(spark, sf):
    from datetime import datetime

    from weft.operators.definitions import ingest, list_definitions

    v1 = ingest(part_documents(spark, sf), processed_at=F.lit(datetime(2025, 1, 1)).cast("timestamp")).definitions
    docs2 = part_documents(spark, sf, names=F.upper("p_name")).where(F.col("p_size") > 25)
    v2 = ingest(docs2, processed_at=F.lit(datetime(2025, 6, 1)).cast("timestamp")).definitions
    both = v1.unionByName(v2)
    return list_definitions(both).select(
        "url", "name", F.when(F.month("processedAt") == 6, 2).otherwise(1).cast("int").alias("version_no"))


@register("definition_filters", EXPECTED_ELEMENTS + """
SELECT url, count(*) FILTER (WHERE card_min >= 1) AS n_mandatory,
  count(*) FILTER (WHERE fixed_value IS NOT NULL OR default_value IS NOT NULL) AS n_fixed_or_default,
  count(*) FILTER (WHERE card_min >= 1 AND (fixed_value IS NOT NULL OR default_value IS NOT NULL)) AS n_both,
  count(DISTINCT CASE WHEN starts_with(path, 'Part.') THEN substr(path, 6) ELSE path END) AS n_paths
FROM el GROUP BY url""")
def q_definition_filters(spark, sf):
    r = _ingested(spark, sf)
    e = r.elements.join(r.definitions.select(F.col("id").alias("structureDefinitionId"), "url", "type").hint("merge"),
                        "structureDefinitionId")
    mand = F.col("cardinalityMin") >= 1
    fod = F.col("fixedValue").isNotNull() | F.col("defaultValue").isNotNull()
    rel = F.when(F.col("path").startswith(F.concat(F.col("type"), F.lit("."))),
                 F.expr("substring(path, length(type) + 2)")).otherwise(F.col("path"))
    return e.groupBy("url").agg(
        F.count(F.when(mand, 1)).alias("n_mandatory"), F.count(F.when(fod, 1)).alias("n_fixed_or_default"),
        F.count(F.when(mand & fod, 1)).alias("n_both"), F.count_distinct(rel).alias("n_paths"))


# --------------------------------------------------------------------------- mapping check


def _part_configs(spark, sf):
    p = _dealt_parts(spark, sf)
    cid = F.concat(F.lit("cfg-"), F.col("p_partkey"))
    configs = p.select(cid.alias("id"), cid.alias("name"), F.lit(None).cast("string").alias("description"),
                       F.lit("JSON").alias("sourceType"), F.lit("Part").alias("fhirResourceType"),
                       F.lit("TO_FHIR").alias("direction"),
                       F.concat(F.lit("http://example.org/sd/part-"), F.col("p_partkey")).alias("structureDefinitionUrl"))
    size = F.col("p_size")

    def row(o, target, ttype=None, details=None):
        return F.struct(F.lit(o).alias("ordinal"), target.alias("targetFhirPath"),
                        F.lit(ttype).cast("string").alias("transformationType"),
                        (details if details is not None else F.lit(None).cast("string")).alias("transformationDetails"))

    name_val = F.when(size < 10, F.lit("other")).otherwise(F.col("p_name"))
    rows = F.array(
        row(0, F.lit("name"), "DEFAULT_VALUE", F.to_json(F.struct(name_val.alias("value")))),
        row(1, F.lit("brand[0]")),
        row(2, F.when(size > 25, F.lit("type:main.text")).otherwise(F.lit("size:x"))),
        row(3, F.lit("color")),
        row(4, F.lit("size"), "default_value",
            F.to_json(F.struct((size + F.when(size % 2 == 0, 1).otherwise(0)).alias("value")))),
        row(5, F.when(size > 25, F.lit("status")).otherwise(F.lit("state"))),
    )
    fms = p.select(cid.alias("mappingConfigurationId"), F.explode(rows).alias("m")).select("mappingConfigurationId", "m.*")
    return configs, fms


def _violations(spark, sf):
    from weft.operators.check import check_mappings

    configs, fms = _part_configs(spark, sf)
    r = _ingested(spark, sf)
    return check_mappings(configs, fms, r.definitions, r.elements)


VIOLATIONS_SQL = """
WITH v AS (
  SELECT 'cfg-' || p_partkey AS cfg_name, 1 AS phase, 0 AS ordinal, 'fixed' AS kind, 'name' AS what, p_partkey FROM part WHERE p_size < 10
  UNION ALL SELECT 'cfg-' || p_partkey, 1, 3, 'path', 'color', p_partkey FROM part
  UNION ALL SELECT 'cfg-' || p_partkey, 1, 4, 'fixed', 'size', p_partkey FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT 'cfg-' || p_partkey, 1, 5, 'path', 'state', p_partkey FROM part WHERE p_size <= 25
  UNION ALL SELECT 'cfg-' || p_partkey, 2, 7, 'mandatory', 'status', p_partkey FROM part WHERE p_size <= 25
), r AS (
  SELECT cfg_name, ordinal, kind,
    'Mapping ''' || cfg_name || ''' contains invalid FHIR path '''
      || CASE WHEN kind = 'mandatory' THEN 'Mandatory element ''' ELSE 'Path ''' END || what
      || ''''' according to StructureDefinition ''http://example.org/sd/part-' || p_partkey || '''.' AS message,
    CAST(row_number() OVER (PARTITION BY cfg_name ORDER BY phase, ordinal, CASE WHEN kind = 'path' THEN 0 ELSE 1 END) AS INTEGER) AS rank
  FROM v
)
SELECT cfg_name, CAST(ordinal AS INTEGER) AS ordinal, message, rank FROM r WHERE kind = '{kind}'"""


def _violations_of(kind):
    def q(spark, sf):
        v = _violations(spark, sf)
        return v.where(F.col("kind") == kind).select("cfg_name", F.col("ordinal").cast("int").alias("ordinal"),
                                                     "message", F.col("rank").cast("int").alias("rank"))

    return q


register("path_existence", VIOLATIONS_SQL.replace("{kind}", "path"))(_violations_of("path"))
register("fixed_conflict", VIOLATIONS_SQL.replace("{kind}", "fixed"))(_violations_of("fixed"))
register("mandatory_coverage", VIOLATIONS_SQL.replace("{kind}", "mandatory"))(_violations_of("mandatory"))


@register("stored_value_parse", """
SELECT p_partkey, kind, parsed FROM (
  SELECT p_partkey, 'int' AS kind, CAST(p_size AS VARCHAR) AS parsed FROM part
  UNION ALL SELECT p_partkey, 'code', CAST(to_json(p_brand) AS VARCHAR) FROM part
  UNION ALL SELECT p_partkey, 'bool', CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END FROM part
  UNION ALL SELECT p_partkey, 'cc', '{"text":' || CAST(to_json(p_type) AS VARCHAR) || '}' FROM part
  UNION ALL SELECT p_partkey, 'dec', CAST(p_size AS VARCHAR) || '.5' FROM part
  UNION ALL SELECT p_partkey, 'none', NULL FROM part
  UNION ALL SELECT p_partkey, 'badjson', NULL FROM part
  UNION ALL SELECT p_partkey, 'unknown', CAST(to_json(p_name) AS VARCHAR) FROM part)""")
def q_stored_value_parse(spark, sf):
    from weft.functions.coerce import stored_value_column

    p = table(spark, sf, "part")
    size = F.col("p_size").cast("string")

    def r(kind, value, typ):
        return F.struct(F.lit(kind).alias("kind"), value.alias("v"), F.lit(typ).cast("string").alias("t"))

    rows = F.array(
        r("int", F.concat(size, F.lit("abc")), "integer"), r("code", F.col("p_brand"), "code"),
        r("bool", F.when(F.col("p_size") > 25, F.lit("TRUE")).otherwise(F.lit("no")), "boolean"),
        r("cc", F.concat(F.lit('{"text":"'), F.col("p_type"), F.lit('"}')), "CodeableConcept"),
        r("dec", F.concat(size, F.lit(".5")), "decimal"), r("none", F.col("p_name"), None),
        r("badjson", F.concat(F.lit("{"), F.col("p_name")), "Reference"), r("unknown", F.col("p_name"), "Foo"))
    x = p.select("p_partkey", F.explode(rows).alias("x"))
    return x.select("p_partkey", F.col("x.kind").alias("kind"),
                    stored_value_column(F.col("x.v"), F.col("x.t")).alias("parsed"))


# --------------------------------------------------------------------------- sources and sinks


def _order_pages(spark, sf):
    o = table(spark, sf, "orders")
    entry_t = "struct<fullUrl:string,resource:struct<resourceType:string,id:bigint>>"

    def entry(full, rt, rid):
        res = F.struct(F.lit(rt).alias("resourceType"), rid.alias("id")) if rt else F.lit(None).cast(
            "struct<resourceType:string,id:bigint>")
        return F.struct(F.lit(full).cast("string").alias("fullUrl"), res.alias("resource")).cast(entry_t)

    page = F.struct(
        F.when(F.col("o_orderstatus") == "P", "OperationOutcome").otherwise("Bundle").alias("resourceType"),
        F.array(entry(None, "Encounter", F.col("o_orderkey")), entry("urn:x", None, None),
                entry(None, "Patient", F.col("o_custkey"))).alias("entry"),
        F.array(F.struct(F.lit("self").alias("relation"), F.lit("self").alias("url")),
                F.struct(F.lit("next").alias("relation"),
                         F.when(F.col("o_orderstatus") == "O",
                                F.concat(F.lit("page-"), (F.col("o_orderkey") + 1).cast("string"))).alias("url"))).alias("link"))
    return o.select("o_orderkey", F.parse_json(F.to_json(page)).alias("page"))


@register("bundle_explode", """
SELECT o_orderkey, CAST(0 AS INTEGER) AS entry_pos, 'Encounter' AS resource_type, CAST(o_orderkey AS VARCHAR) AS resource_id
FROM orders WHERE o_orderstatus <> 'P'
UNION ALL
SELECT o_orderkey, CAST(2 AS INTEGER), 'Patient', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus <> 'P'""")
def q_bundle_explode(spark, sf):
    from weft.sources.bundles import bundle_resources

    r = bundle_resources(_order_pages(spark, sf), "page", keep=("o_orderkey",))
    return r.select("o_orderkey", F.col("entry_pos").cast("int").alias("entry_pos"),
                    F.try_variant_get("resource", "$.resourceType", "string").alias("resource_type"),
                    F.to_json(F.try_variant_get("resource", "$.id", "variant")).alias("resource_id"))


@register("next_link", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'page-' || (o_orderkey + 1) END AS next_url FROM orders""")
def q_next_link(spark, sf):
    from weft.sources.bundles import next_link

    return _order_pages(spark, sf).select("o_orderkey", next_link(F.col("page")).alias("next_url"))


@register("identifier_resolution", """
SELECT CASE WHEN p_size > 33 THEN 'http://example.org/sd/part-' || p_partkey
            WHEN p_size > 16 THEN 'StructureDefinition/part-' || p_partkey
            WHEN p_size > 5 THEN 'part-' || p_partkey
            ELSE 'http://nowhere.example/part-' || p_partkey END AS identifier,
       CASE WHEN p_size > 33 OR p_size <= 5 THEN 'url' ELSE 'id' END AS kind,
       CASE WHEN p_size > 5 THEN 'http://example.org/sd/part-' || p_partkey END AS url
FROM part""")
def q_identifier_resolution(spark, sf):
    from weft.operators.definitions import resolve_identifiers

    p = table(spark, sf, "part")
    k = F.col("p_partkey").cast("string")
    ident = (F.when(F.col("p_size") > 33, F.concat(F.lit("http://example.org/sd/part-"), k))
             .when(F.col("p_size") > 16, F.concat(F.lit("StructureDefinition/part-"), k))
             .when(F.col("p_size") > 5, F.concat(F.lit("part-"), k))
             .otherwise(F.concat(F.lit("http://nowhere.example/part-"), k)))
    ids = p.select(ident.alias("identifier"))
    return resolve_identifiers(ids, _ingested(spark, sf).definitions).select("identifier", "kind", "url")


@register("push_plan", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'POST' ELSE 'PUT' END AS method,
  'http://fhir.example.org/Patient' || CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE '/' || c_custkey END AS url
FROM customer""")
def q_push_plan(spark, sf):
    from weft.sinks import push_plan

    c = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_custkey")).alias("rid"), "c_name")
    r = map_in(c, cfg("Push", "Patient", fm(0, "rid", "id"), fm(1, "c_name", "name[0].text")),
               keep=("c_custkey",), keep_original=False)
    plan = push_plan(r.df, "Patient", "http://fhir.example.org", "PUT", keep=("c_custkey",))
    return plan.select("c_custkey", "method", "url")


@register("flatten_csv", f"""
SELECT c_custkey, 'Patient' AS resourceType, 'http://example.org/sd/patient' AS "meta.profile", c_custkey AS id,
  '[object Object]' AS name, {GENDER_SQL} AS gender FROM customer""")
def q_flatten_csv(spark, sf):
    from weft.sinks import flatten_columns

    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    m = MappingConfig(CUSTOMER_TO_PATIENT.name, "Patient", mappings=CUSTOMER_TO_PATIENT.mappings,
                      definition_url="http://example.org/sd/patient")
    r = map_in(c, m, keep=("c_custkey",), keep_original=False)
    return r.df.select("c_custkey", *flatten_columns(F.col("item"), r.item_type, ""))


@register("run_counts", ORDER_ERRORS_CTE + """
, b AS (SELECT count(DISTINCT o_orderkey) AS n, count(*) AS f FROM e), o AS (SELECT count(*) AS n FROM orders)
SELECT o.n AS records, o.n - b.n AS data, b.n AS errors, b.f AS field_errors, o.n AS lines FROM o, b""")
def q_run_counts(spark, sf):
    """A2: what a run counted as it was written, beside the lines that it wrote."""
    from weft.session import scratch_path
    from weft.sinks import counted, write_ndjson

    out = scratch_path(spark, f"run_counts-{uuid.uuid4().hex}")
    rows, seen = counted(order_checks(spark, sf).df)
    write_ndjson(rows, out)
    counts = [F.lit(seen.get[c]).cast("bigint").alias(c) for c in ("records", "data", "errors", "field_errors")]
    return spark.read.text(out).agg(F.count(F.lit(1)).alias("lines")).select(*counts, "lines")


@register("write_csv_variant", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, '[object Object]' AS links, CASE WHEN o_orderkey % 3 = 0 THEN replace(o_orderpriority, '-', '"') END AS "note.text",
  o_orderstatus AS "status.code", o_orderpriority || ';;' || CAST(o_custkey AS VARCHAR) AS tags
FROM orders""")
def q_write_csv_variant(spark, sf):
    """K3 + C6: VARIANT items; the first record's leaves are the header; a third of the records has a note like its own, the others a deeper one or none."""
    from weft.session import scratch_path
    from weft.sinks import write_csv_dynamic

    key, quoted = F.col("o_orderkey"), F.replace("o_orderpriority", F.lit("-"), F.lit('"'))
    same = [key.alias("id"), F.struct(F.col("o_orderstatus").alias("code")).alias("status"), F.array(F.struct(key.alias("a"))).alias("links"),
            F.array("o_orderpriority", F.lit(None).cast("string"), F.col("o_custkey").cast("string")).alias("tags")]
    like = F.to_json(F.struct(*same, F.struct(quoted.alias("text")).alias("note")))
    deeper = F.to_json(F.struct(*same, F.struct(F.struct(quoted.alias("deep")).alias("text")).alias("note"), F.lit(1).alias("extra")))
    text = F.when(key % 3 == 0, like).when(key % 3 == 1, deeper).otherwise(F.to_json(F.struct(*same)))
    items = table(spark, sf, "orders").select("o_orderkey", F.parse_json(text).alias("item"), F.array().cast("array<string>").alias("errors"))
    out = scratch_path(spark, f"csv_variant-{uuid.uuid4().hex}")
    write_csv_dynamic(items, out, first_by="o_orderkey")
    return spark.read.option("header", True).option("escape", '"').csv(out)


@register("csv_cell_typing", """
SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS j_key, CAST(to_json(c_mktsegment) AS VARCHAR) AS j_seg,
  CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS j_flag, CAST(c_nationkey AS VARCHAR) AS j_nation,
  CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE '1.5' END AS j_num,
  '"2025-01-' || lpad(CAST(c_nationkey % 28 + 1 AS VARCHAR), 2, '0') || '"' AS j_date
FROM customer""")
def q_csv_cell_typing(spark, sf):
    from weft.functions.coerce import type_cell

    c = table(spark, sf, "customer")
    cells = {
        "j_key": F.col("c_custkey").cast("string"),
        "j_seg": F.col("c_mktsegment"),
        "j_flag": F.when(F.col("c_custkey") % 2 == 0, F.lit("TRUE")).otherwise(F.lit("false")),
        "j_nation": F.lpad(F.col("c_nationkey").cast("string"), 3, "0"),
        "j_num": F.when(F.col("c_mktsegment") == "BUILDING", F.lit("")).otherwise(F.lit("1.50")),
        "j_date": F.concat(F.lit("2025-01-"), F.lpad((F.col("c_nationkey") % 28 + 1).cast("string"), 2, "0")),
    }
    return c.select("c_custkey", *[F.to_json(type_cell(v)).alias(k) for k, v in cells.items()])


def _variant_patients(df: DataFrame) -> DataFrame:
    r = map_in(df, CUSTOMER_TO_PATIENT, variant_col="record", keep=("c_custkey",), keep_original=False)
    i = F.col("item")
    return r.df.select(
        "c_custkey", F.try_variant_get(i["id"], "$", "bigint").alias("id"),
        F.try_variant_get(F.get(i["name"], 0)["text"], "$", "string").alias("name_text"),
        i["gender"].alias("gender"), F.size("errors").alias("n_errors"))


@register("json_records", SQL["map_in_customer"])
def q_json_records(spark, sf):
    from weft.session import scratch_path
    from weft.sources.records import read_json_records

    out = scratch_path(spark, f"json_records-{uuid.uuid4().hex}")
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment").write.mode("overwrite").json(out)
    recs = read_json_records(spark, out)
    return _variant_patients(recs.select(F.try_variant_get("record", "$.c_custkey", "bigint").alias("c_custkey"),
                                         "record"))


@register("inline_records", SQL["map_in_customer"])
def q_inline_records(spark, sf):
    from weft.sources.records import parse_json_column

    c = table(spark, sf, "customer").select(
        "c_custkey", F.to_json(F.struct("c_custkey", "c_name", "c_mktsegment")).alias("text"))
    return _variant_patients(parse_json_column(c, "text", keep=("c_custkey",)))


@register("stream_map_in", SQL["map_in_customer"])
def q_stream_map_in(spark, sf):
    """X1 + X2: the same compiled plan on a Structured Streaming source (availableNow)."""
    from weft.session import scratch_path

    base = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    schema = table(spark, sf, "customer").schema
    src = (spark.readStream.schema(schema).option("pathGlobFilter", "customer.parquet").option("maxFilesPerTrigger", 1)
           .parquet(sf).select("c_custkey", "c_name", "c_mktsegment"))
    out = _patient_columns(map_in(src, CUSTOMER_TO_PATIENT, keep=("c_custkey",), keep_original=False).df)

    def write(batch: DataFrame, batch_id: int) -> None:  # idempotent per batch id
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    q = (out.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")


@register("malformed_routing", """
SELECT 'page' AS kind, page_id AS id, NOT json_valid(html) AS is_malformed FROM pages
UNION ALL SELECT 'event', event_id, NOT json_valid(props) FROM events""")
def q_malformed_routing(spark, sf):
    from weft.sources.records import parse_json_column

    texts = table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"),
                                             F.col("html").alias("text")) \
        .unionByName(table(spark, sf, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"),
                                                       F.col("props").alias("text")))
    parsed = parse_json_column(texts, "text", keep=("kind", "id"))
    return parsed.select("kind", "id", F.col("_corrupt_record").isNotNull().alias("is_malformed"))


# --------------------------------------------------------------------------- control tables, split output, store


def _control_tables(spark):
    """mapping_configurations / field_mappings rows for two configs (ordinals out of order)."""
    import json as _json

    from weft.plans.config import FIELD_MAPPINGS_DDL, MAPPING_CONFIGURATIONS_DDL

    configs = spark.createDataFrame([
        ("c1", "CustomerToPatient", None, "JSON", "Patient", "TO_FHIR", None, None, None),
        ("c2", "Other", None, "CSV", "Patient", "TO_FHIR", None, None, None)], MAPPING_CONFIGURATIONS_DDL)
    rows = []
    for i, m in enumerate(CUSTOMER_TO_PATIENT.mappings):
        rows.append((f"f{i}", "c1", m.ordinal, m.source_path, m.target_path, m.transformation_type,
                     None if m.transformation_details is None else _json.dumps(m.transformation_details),
                     m.validation_type, None if m.validation_details is None else _json.dumps(m.validation_details),
                     None, None, None))
    rows.append(("g0", "c2", 0, "x", "gender", None, None, None, None, None, None, None))
    rows.append(("f9", "c1", 9, "c_name", None, None, None, None, None, None, None, None))  # no target: skipped (F7)
    fms = spark.createDataFrame(list(reversed(rows)), FIELD_MAPPINGS_DDL)
    return configs, fms


@register("config_load", SQL["map_in_customer"])
def q_config_load(spark, sf):
    """S6 + J1 + F7: the configuration is read from control tables by name."""
    from weft.plans.config import load_mapping

    configs, fms = _control_tables(spark)
    m = load_mapping(configs, fms, "CustomerToPatient")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return _patient_columns(map_in(c, m, keep=("c_custkey",), keep_original=False).df)


@register("split_write", ORDER_ERRORS_CTE + """
, flags AS (SELECT o.o_orderkey, EXISTS (SELECT 1 FROM e WHERE e.o_orderkey = o.o_orderkey) AS bad FROM orders o)
SELECT CASE WHEN bad THEN 'error' ELSE 'data' END AS type, count(*) AS n FROM flags GROUP BY 1""")
def q_split_write(spark, sf):
    """K1 + K2: tagged NDJSON written once, split into type=data / type=error folders, read back."""
    from weft.session import scratch_path
    from weft.sinks import write_split

    out = scratch_path(spark, f"split-{uuid.uuid4().hex}")
    write_split(order_checks(spark, sf).df, out)
    back = spark.read.text(out)
    return back.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@register("pretty_json", """
SELECT c_custkey, true AS same_value, true AS multi_line FROM customer""")
def q_pretty_json(spark, sf):
    """K4: pretty text parses back to the same resource."""
    from weft.sinks import pretty_json

    df = customer_patients(spark, sf).df
    p = pretty_json(F.col("item"))
    return df.select("c_custkey", (F.to_json(F.parse_json(p)) == F.to_json(F.parse_json(F.to_json("item")))).alias("same_value"),
                     F.instr(p, "\n").cast("boolean").alias("multi_line"))


@register("store_roundtrip", f"""
SELECT {PART_URL} AS url, CAST(6 AS BIGINT) AS n_elements FROM part WHERE p_size <= 40""")
def q_store_roundtrip(spark, sf):
    """K6 + K7: append a profile version, delete the elements of some definitions
    (tombstones), read the store back."""
    from weft.operators.definitions import delete_elements, read_store, store
    from weft.session import scratch_path

    root = scratch_path(spark, f"store-{uuid.uuid4().hex}")
    r = _ingested(spark, sf)
    store(r, root)
    defs, _ = read_store(spark, root)
    big = table(spark, sf, "part").where(F.col("p_size") > 40).select(
        F.concat(F.lit("http://example.org/sd/part-"), F.col("p_partkey")).alias("url"))
    delete_elements(defs.join(big.hint("merge"), "url", "left_semi").select(F.col("id").alias("structureDefinitionId")), root)
    defs, els = read_store(spark, root)
    return els.join(defs.select(F.col("id").alias("structureDefinitionId"), "url").hint("merge"), "structureDefinitionId") \
        .groupBy("url").agg(F.count(F.lit(1)).alias("n_elements"))


@register("auto_fill_fanout", """
SELECT o_orderkey,
  CASE WHEN o_orderstatus = 'P' THEN '[{"system":"phone"}]'
       ELSE '[{"value":' || CAST(to_json(o_orderpriority) AS VARCHAR) || ',"system":"phone"},{"value":'
            || CAST(to_json(o_orderstatus) AS VARCHAR) || ',"system":"phone"}]' END AS telecom_json
FROM orders""")
def q_auto_fill_fanout(spark, sf):
    """R1 + P11 + H5: a per-row array mapped as a whole, then a profile fixed value
    fanned out over every element (row-dependent length; empty → one new element)."""
    from weft.plans.config import Definition, Element, profile_from_definition

    vals = F.array(F.struct(F.col("o_orderpriority").alias("value")), F.struct(F.col("o_orderstatus").alias("value")))
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", F.array().cast("array<struct<value:string>>"))
        .otherwise(vals).alias("phones"))
    d = Definition("http://example.org/sd/contact", "Patient", (
        Element("Patient", 0, "*"), Element("Patient.telecom", 0, "*", ordinal=1),
        Element("Patient.telecom.system", 0, "1", fixed_value="phone", fixed_type="code", ordinal=2)))
    m = cfg("Fanout", "Patient", fm(0, "phones", "telecom"), url="http://example.org/sd/contact")
    r = map_in(o, m, profile_from_definition(d), keep=("o_orderkey",), keep_original=False)
    return r.df.select("o_orderkey", F.to_json("item.telecom").alias("telecom_json"))


@register("set_replace_scalar", """
SELECT c_custkey,
  CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(to_json(c_mktsegment) AS VARCHAR)
       ELSE '{"text":' || CAST(to_json(c_name) AS VARCHAR) || '}' END AS code_json
FROM customer""")
def q_set_replace_scalar(spark, sf):
    """A scalar written first is replaced by the object a later write below it creates."""
    c = table(spark, sf, "customer").select(
        "c_custkey", "c_mktsegment", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")).alias("nm"))
    m = cfg("Replace", "Observation", fm(0, "c_mktsegment", "code"), fm(1, "nm", "code.text"))
    r = map_in(c, m, keep=("c_custkey",), keep_original=False)
    return r.df.select("c_custkey", F.to_json("item.code").alias("code_json"))


@register("set_replay_order", """
SELECT c_custkey,
  CASE WHEN c_mktsegment = 'BUILDING'
       THEN '[{"use":"BUILDING"},{"system":"cns","period":"BUILDING"}]'
       ELSE '[{"system":"cns","value":' || CAST(to_json(c_name) AS VARCHAR) || ',"use":'
            || CAST(to_json(c_mktsegment) AS VARCHAR) || ',"period":' || CAST(to_json(c_mktsegment) AS VARCHAR)
            || ',"type":' || CAST(to_json(c_name) AS VARCHAR) || '}]' END AS identifier_json
FROM customer""")
def q_set_replay_order(spark, sf):
    """H3: filter, then index, then filter again, then fan-out on one array — whether
    [0] lands on the filter element depends on which writes fired in the row."""
    c = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")).alias("cns"), "c_mktsegment")
    m = cfg("Replay", "Patient", fm(0, "cns", "identifier[?system='cns'].value"),
            fm(1, "c_mktsegment", "identifier[0].use"), fm(2, "c_mktsegment", "identifier[?system='cns'].period"),
            fm(3, "cns", "identifier.type"))
    r = map_in(c, m, keep=("c_custkey",), keep_original=False)
    return r.df.select("c_custkey", F.to_json("item.identifier").alias("identifier_json"))


# --- input shapes, patterns and look-ups beyond the plain ones ---

def _dates(spark, sf, shown: str, source: str, target: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", shown).alias("d"))
    c = cfg("Dates", "Encounter", fm(0, "d", "period.start", None, None, "FORMAT_DATE", {"inputFormat": source, "outputFormat": target}))
    p = map_in(o, c, keep=("o_orderkey",), keep_original=False)
    return p.df.select("o_orderkey", F.col("item.period.start").alias("value"), F.get("errors", 0)["message"].alias("message"))


@register("format_date_compact", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS value, CAST(NULL AS VARCHAR) AS message FROM orders""")
def q_format_date_compact(spark, sf):
    """Numbers that touch are parted by their widths."""
    return _dates(spark, sf, "yyyyMMdd", "yyyyMMdd", "yyyy-MM-dd")


@register("format_date_two_digit_year", """
SELECT o_orderkey, CASE WHEN y > year(current_date) + 50 THEN y - 100 ELSE y END || strftime(o_orderdate, '-%m-%d') AS value,
  CAST(NULL AS VARCHAR) AS message
FROM (SELECT *, 2000 + CAST(strftime(o_orderdate, '%y') AS INTEGER) AS y FROM orders)""")
def q_format_date_two_digit_year(spark, sf):
    """A two-digit year is the one nearest to now."""
    return _dates(spark, sf, "dd/MM/yy", "dd/MM/yy", "yyyy-MM-dd")


@register("format_date_ordinal", """
SELECT o_orderkey, d || CASE WHEN d BETWEEN 11 AND 13 THEN 'th' WHEN d % 10 = 1 THEN 'st' WHEN d % 10 = 2 THEN 'nd' WHEN d % 10 = 3 THEN 'rd' ELSE 'th' END
  || strftime(o_orderdate, ' %B %Y') AS value, CAST(NULL AS VARCHAR) AS message
FROM (SELECT *, day(o_orderdate) AS d FROM orders)""")
def q_format_date_ordinal(spark, sf):
    return _dates(spark, sf, "yyyy-MM-dd", "yyyy-MM-dd", "do MMMM yyyy")


@register("format_date_bad_pattern", """
SELECT o_orderkey, CAST(NULL AS VARCHAR) AS value, 'Error formatting date: unsupported token `DD` in `DD/MM/YYYY`' AS message FROM orders""")
def q_format_date_bad_pattern(spark, sf):
    """A pattern that can't be used is an error of each record, not of the job."""
    return _dates(spark, sf, "dd/MM/yyyy", "DD/MM/YYYY", "yyyy-MM-dd").withColumn("value", F.lit(None).cast("string"))


@register("regex_syntax", r"""
SELECT page_id, CASE WHEN NOT regexp_matches(url, '^ht{2}ps?://[^\s\[]+e\d$')
  THEN 'Value ''' || url || ''' does not match pattern /^ht{2}ps?://[^\s[]+e\d$/.' END AS message FROM pages""")
def q_regex_syntax(spark, sf):
    """V2: a bracket inside a class is a character."""
    return _validate(spark, sf, "pages", "page_id", "url", "REGEX", {"pattern": r"^ht{2}ps?://[^\s[]+e\d$"})


@register("csv_records", """
SELECT c_custkey, 'He said "' || c_name || '",' || chr(10) || 'then left' AS text, c_custkey % 5 = 4 AS bad FROM customer WHERE c_custkey % 5 <> 4
UNION ALL SELECT NULL, NULL, TRUE FROM customer WHERE c_custkey % 5 = 4""")
def q_csv_records(spark, sf):
    """S1 over files: quoted line breaks and quotes; rows with a cell too many are reported."""
    from weft.session import scratch_path
    from weft.sources.records import read_csv_records

    out = scratch_path(spark, f"csv_records-{uuid.uuid4().hex}")
    said = F.concat(F.lit('He said "'), F.col("c_name"), F.lit('",\n'), F.lit("then left"))
    cell = F.concat(F.lit('"'), F.replace(said, F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), cell, F.when(F.col("c_custkey") % 5 == 4, F.lit("more")))
    rows = table(spark, sf, "customer").select(F.col("c_custkey"), line.alias("value"))
    # each file: the header, then its rows
    files = rows.groupBy(F.expr("c_custkey div 500").alias("f")).agg(F.concat_ws("\n", F.lit("id,text"), F.concat_ws("\n", F.collect_list("value"))).alias("value"))
    files.select("f", "value").write.partitionBy("f").text(out)
    recs = read_csv_records(spark, f"{out}/f=*")
    r = F.col("record")
    return recs.select(F.try_variant_get(r, "$.id", "bigint").alias("c_custkey"), F.try_variant_get(r, "$.text", "string").alias("text"),
                       F.col("_corrupt_record").isNotNull().alias("bad"))


@register("json_concatenated", """
SELECT c_custkey, unnest([1, 2]) AS n, c_name AS name FROM customer""")
def q_json_concatenated(spark, sf):
    """Several values on a line are records of their own."""
    from weft.session import scratch_path
    from weft.sources.records import read_json_records

    out = scratch_path(spark, f"json_concatenated-{uuid.uuid4().hex}")
    c = table(spark, sf, "customer")
    value = lambda n: F.to_json(F.struct(F.col("c_custkey").alias("k"), F.lit(n).alias("n"), F.concat(F.col("c_name"), F.lit("} {")).alias("name")))
    c.select(F.concat(value(1), value(2)).alias("value")).write.text(out)
    r = F.col("record")
    recs = read_json_records(spark, out).where("_corrupt_record is null")
    return recs.select(F.try_variant_get(r, "$.k", "bigint").alias("c_custkey"), F.try_variant_get(r, "$.n", "int").alias("n"),
                       F.regexp_replace(F.try_variant_get(r, "$.name", "string"), r"\} \{$", "").alias("name"))


@register("code_lookup_large", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3000 < 2500 THEN 'name of ' || l_partkey % 3000 ELSE 'none' END AS code FROM lineitem""")
def q_code_lookup_large(spark, sf):
    """T4 with thousands of codes: a look-up reads a few, however many there are."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 3000).alias("k"))
    codes = {str(i): f"name of {i}" for i in range(2500)}
    c = cfg("Codes", "Device", fm(0, "k", "code", None, None, "CODE_LOOKUP", {"map": codes, "defaultValue": "none"}))
    p = map_in(li, c, keep=("l_orderkey", "l_linenumber"), keep_original=False)
    return p.df.select("l_orderkey", "l_linenumber", F.col("item.code").alias("code"))


@register("identifier_duplicates", """
SELECT 'http://example.org/sd/part-' || p_partkey AS identifier, 'http://example.org/sd/part-' || p_partkey AS url, 1 AS one
FROM part UNION ALL SELECT 'http://example.org/sd/part-' || p_partkey, 'http://example.org/sd/part-' || p_partkey, 1 FROM part""")
def q_identifier_duplicates(spark, sf):
    """C11: equal identifiers are rows of their own."""
    from weft.operators.definitions import resolve_identifiers

    ids = table(spark, sf, "part").select(F.concat(F.lit("http://example.org/sd/part-"), F.col("p_partkey").cast("string")).alias("identifier"))
    return resolve_identifiers(ids.union(ids), _ingested(spark, sf).definitions).select("identifier", "url", F.lit(1).alias("one"))


@register("store_twice", f"""
SELECT {PART_URL} AS url, CAST(CASE WHEN p_size > 40 THEN 6 ELSE 12 END AS BIGINT) AS n_elements FROM part""")
def q_store_twice(spark, sf):
    """K6 + K7: an ingest stored twice is there once; elements appended stay
    beside it, and after a delete only what is appended later is there."""
    from weft.operators import definitions as d
    from weft.session import scratch_path

    root = scratch_path(spark, f"store-{uuid.uuid4().hex}")
    r = d.written(_ingested(spark, sf))
    d.store(r, root)
    d.store(r, root)
    defs, els = d.read_store(spark, root)
    big = table(spark, sf, "part").where(F.col("p_size") > 40).select(
        F.concat(F.lit("http://example.org/sd/part-"), F.col("p_partkey").cast("string")).alias("url"))
    d.delete_elements(defs.join(big.hint("merge"), "url", "left_semi").select(F.col("id").alias("structureDefinitionId")), root)
    d.append_elements(r.elements, root)
    defs, els = d.read_store(spark, root)
    return els.join(defs.select(F.col("id").alias("structureDefinitionId"), "url").hint("merge"), "structureDefinitionId") \
        .groupBy("url").agg(F.count(F.lit(1)).alias("n_elements"))


def _written(spark, sf, key: str, *writes) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", F.struct(F.col("c_name").alias("text")).alias("whole"))
    m = cfg("Writes", "Observation", *[fm(i, s, t) for i, (s, t) in enumerate(writes)])
    r = map_in(c, m, keep=("c_custkey",), keep_original=False)
    return r.df.select("c_custkey", F.to_json(f"item.{key}").alias("j"))


@register("set_index_then_filter", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '[{"system":"BUILDING","value":"' || c_name || '"}]'
  ELSE '[{"system":"' || c_mktsegment || '"},{"system":"BUILDING","value":"' || c_name || '"}]' END AS j FROM customer""")
def q_set_index_then_filter(spark, sf):
    """P10, H3: a filter on the key an index wrote finds that element in some rows and makes one in others."""
    return _written(spark, sf, "identifier", ("c_mktsegment", "identifier[0].system"), ("c_name", "identifier[?system='BUILDING'].value"))


@register("set_mixed_slots", """
SELECT c_custkey, '["' || c_name || '",{},{"url":"' || c_mktsegment || '"}]' AS j FROM customer""")
def q_set_mixed_slots(spark, sf):
    """Values and objects in one array."""
    return _written(spark, sf, "extension", ("c_mktsegment", "extension[2].url"), ("c_name", "extension[0]"))


@register("set_list_below_value", """
SELECT c_custkey, '{"coding":[{"code":"' || c_mktsegment || '"}],"text":"' || c_name || '"}' AS j FROM customer""")
def q_set_list_below_value(spark, sf):
    """A list below an object that was written whole."""
    return _written(spark, sf, "code", ("whole", "code"), ("c_mktsegment", "code.coding[0].code"))


@register("set_resource_type", """
SELECT c_custkey, '"' || c_mktsegment || '"' AS j FROM customer""")
def q_set_resource_type(spark, sf):
    """A write to resourceType replaces the stamp."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    r = map_in(c, cfg("Type", "Observation", fm(0, "c_mktsegment", "resourceType")), keep=("c_custkey",), keep_original=False)
    whole = F.to_json("item")
    return r.df.select("c_custkey", F.regexp_extract(whole, r'^\{"resourceType":("[^"]*")\}$', 1).alias("j"))


def _mixed_csv(spark, sf) -> str:
    """Customers as CSV files of three kinds: two orders of columns, and one with another column."""
    from weft.session import scratch_path

    out = scratch_path(spark, f"csv_mixed-{uuid.uuid4().hex}")
    c = table(spark, sf, "customer")
    for k, cols in enumerate((("c_custkey", "c_name", "c_mktsegment"), ("c_mktsegment", "c_custkey", "c_name"), ("c_acctbal", "c_name", "c_custkey", "c_mktsegment"))):
        c.where(F.col("c_custkey") % 3 == k).select(*cols).write.option("header", True).csv(f"{out}/k={k}")
    return f"{out}/k=*"


@register("csv_mixed_headers", """
SELECT c_custkey, c_name AS name, c_mktsegment AS segment, CASE WHEN c_custkey % 3 = 2 THEN CAST(c_acctbal AS DOUBLE) END AS acctbal FROM customer""")
def q_csv_mixed_headers(spark, sf):
    """Files of one folder with headers of their own; names follow each file's."""
    from weft.sources.records import read_csv_records

    recs = read_csv_records(spark, _mixed_csv(spark, sf))
    r = F.col("record")
    return recs.select(F.try_variant_get(r, "$.c_custkey", "bigint").alias("c_custkey"), F.try_variant_get(r, "$.c_name", "string").alias("name"),
                       F.try_variant_get(r, "$.c_mktsegment", "string").alias("segment"), F.try_variant_get(r, "$.c_acctbal", "double").alias("acctbal"))


@register("csv_stream", f"""
SELECT 'data' AS type, c_custkey AS id, c_name AS name_text, {GENDER_SQL} AS gender FROM customer""")
def q_csv_stream(spark, sf):
    """X1 + X2: CSV files with headers of their own as a stream, mapped and written by the library's own writer, read back."""
    from weft.session import scratch_path
    from weft.streaming import read_record_stream, start_map_in_stream

    base = scratch_path(spark, f"csv_stream-{uuid.uuid4().hex}")
    stream = read_record_stream(spark, _mixed_csv(spark, sf), "csv")
    start_map_in_stream(stream, CUSTOMER_TO_PATIENT, f"{base}/out", f"{base}/checkpoint", variant_col="record").awaitTermination()
    line = F.from_json("value", "type string, item struct<id:bigint,name:array<struct<text:string>>,gender:string>")
    back = spark.read.text(f"{base}/out").select(line.alias("l"))
    return back.select("l.type", "l.item.id", F.get("l.item.name", 0)["text"].alias("name_text"), "l.item.gender")


PART_TO_DEVICE = cfg(
    "PartToDevice", "Device",
    fm(0, "p_partkey", "id"),
    fm(1, "p_type", "type.text", None, None, "CODE_LOOKUP", {"table": "types"}),
    fm(2, "p_type", "model", None, None, "CODE_LOOKUP", {"table": "types", "defaultValue": "unknown"}),
    fm(3, "p_size", "size", None, None, "CODE_LOOKUP", {"table": "sizes", "defaultValue": 0}),
)


@register("map_in_code_table", """
WITH c AS (SELECT DISTINCT p_type AS code FROM part WHERE length(p_type) % 5 <> 0)
SELECT p_partkey, code IS NULL AS failed, 'is ' || code AS text, coalesce('is ' || code, 'unknown') AS model, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS BIGINT) * 10 ELSE 0 END AS size,
  CASE WHEN code IS NULL THEN 'Value ''' || p_type || ''' not found in CODE_LOOKUP map and no defaultValue provided' END AS message
FROM part LEFT JOIN c ON p_type = code""")
def q_map_in_code_table(spark, sf):
    """J4 + T4: codes held in tables, joined within a mapping; a missing code is the default or the field's error."""
    p = table(spark, sf, "part")
    # codes as often as there are such parts
    types = p.where(F.length("p_type") % 5 != 0).select(F.col("p_type").alias("code"), F.concat(F.lit("is "), "p_type").alias("value"))
    sizes = p.where(F.col("p_size") % 2 == 0).select(F.col("p_size").alias("code"), (F.col("p_size").cast("bigint") * 10).alias("value"))
    r = map_in(p.select("p_partkey", "p_type", "p_size"), PART_TO_DEVICE, keep=("p_partkey",), keep_original=False, code_tables={"types": types, "sizes": sizes}).df
    return r.select("p_partkey", (F.size("errors") > 0).alias("failed"), F.col("item.type.text").alias("text"), F.col("item.model").alias("model"),
                    F.col("item.size").alias("size"), F.get("errors", 0)["message"].alias("message"))


ORDER_TO_TASK = cfg(
    "OrderToTask", "Task",
    fm(0, "o_orderkey", "id"),
    fm(1, "o_orderpriority", "priority", "REGEX", {"pattern": "^[1-4]"}, "STRING_CASE", {"case": "lower"}),
)
ORDER_TO_INVOICE = cfg(
    "OrderToInvoice", "Invoice",
    fm(0, "o_orderkey", "identifier[0].value"),
    fm(1, "o_custkey", "subject.reference", "REQUIRED"),
)


@register("map_in_many_configs", r"""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'OrderToTask' WHEN 'O' THEN 'Order/Invoice' ELSE 'no ''such''' END AS config,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority SIMILAR TO '[1-4].*' THEN 'Task' WHEN o_orderstatus = 'O' THEN 'Invoice' END AS made,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority SIMILAR TO '[1-4].*' THEN lower(o_orderpriority) END AS priority,
  CASE WHEN o_orderstatus = 'O' THEN o_custkey END AS subject,
  CASE WHEN o_orderstatus = 'P' THEN 'Mapping configuration ''no ''such'''' not found' WHEN o_orderstatus = 'F' AND NOT o_orderpriority SIMILAR TO '[1-4].*' THEN 'Value ''' || o_orderpriority || ''' does not match pattern /^[1-4]/.' END AS message
FROM orders""")
def q_map_in_many_configs(spark, sf):
    """Every record names its config; two configs are run over one scan, the third isn't known."""
    from weft.operators.map_many import map_in_many

    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    name = F.when(F.col("o_orderstatus") == "F", "OrderToTask").when(F.col("o_orderstatus") == "O", "Order/Invoice").otherwise("no 'such'")
    r = map_in_many(o, name, {"OrderToTask": ORDER_TO_TASK, "Order/Invoice": ORDER_TO_INVOICE}, keep=("o_orderkey",), keep_original=False)
    clean = lambda path, t: F.when(F.size("errors") == 0, F.try_variant_get(F.col("item"), path, t))
    return r.select("o_orderkey", "config", clean("$.resourceType", "string").alias("made"), clean("$.priority", "string").alias("priority"),
                    clean("$.subject.reference", "bigint").alias("subject"), F.get("errors", 0)["message"].alias("message"))


def _replayed(spark, sf, *mappings) -> DataFrame:
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", F.struct(F.col("n_regionkey").alias("region"), F.col("n_name").alias("text")).alias("o"))
    r = map_in(n, cfg("Replayed", "Basic", *mappings), keep=("n_nationkey",), keep_original=False).df
    return r.select("n_nationkey", F.regexp_extract(F.to_json("item"), r'"(?:code|link|item)":(.*)\}$', 1).alias("j"))


@register("set_whole_between", """
SELECT n_nationkey, '{"coding":[{"code":"' || n_name || '"}],"region":' || n_regionkey || ',"text":"' || n_name || '"}' AS j FROM nation""")
def q_set_whole_between(spark, sf):
    """A whole value between writes below its key replaces the first and is written into by the second."""
    return _replayed(spark, sf, fm(0, "n_nationkey", "code.other"), fm(1, "o", "code"), fm(2, "n_name", "code.coding[0].code"))


@register("set_values_any_order", """
SELECT n_nationkey, '["' || n_name || '",' || n_nationkey || ',null,"' || n_name || '"]' AS j FROM nation""")
def q_set_values_any_order(spark, sf):
    """Values (not objects) of an array, written out of order after an object was written to its place."""
    return _replayed(spark, sf, fm(0, "n_name", "link[?k='v'].x"), fm(1, "n_name", "link[3]"), fm(2, "n_nationkey", "link[1]"), fm(3, "n_name", "link[0]"))


@register("set_filter_then_lists", """
SELECT n_nationkey, '[{"coding":[{"code":' || n_nationkey || ',"system":"s"}],"k":"v","text":"' || n_name || '"}]' AS j FROM nation""")
def q_set_filter_then_lists(spark, sf):
    """P10: lists and filters below an element that a filter made and an index finds again."""
    return _replayed(spark, sf, fm(0, "n_name", "item[?k='v'].text"), fm(1, "n_nationkey", "item[0].coding[?system='s'].code"))
