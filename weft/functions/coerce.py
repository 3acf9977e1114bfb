"""Value coercions shared by validations, transformations and sinks.

* :func:`js_string` — C2, the text a value prints as (``String(v)``).
* :func:`json_text` — JSON encoding of a value (error ``inputValue``).
* :func:`type_cell`  — C1, per-cell typing of CSV text into VARIANT.
* :func:`parse_stored` / :func:`stored_value_column` — C3, stored fixed/default
  values by FHIR type, on the driver and as a column expression.
"""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.paths import Val, variant_kind

# Whitespace removed by String.prototype.trim().
JS_WHITESPACE = (
    "\\t\\n\\u000B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
)
BLANK_RE = f"^[{JS_WHITESPACE}]*$"

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def js_number(x: Column) -> Column:
    """Print a double the way a JS number prints (``7`` not ``7.0``)."""
    d = x.cast("double")
    ad = F.abs(d)
    java = d.cast("string")
    sci = F.regexp_replace(F.regexp_replace(java, r"\.0E", "E"), r"E(\d)", "E+$1")
    plain_frac = F.regexp_replace(
        F.regexp_replace(java.cast("decimal(38,20)").cast("string"), r"0+$", ""), r"\.$", ""
    )
    return (
        F.when(d.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(d), F.lit("NaN"))
        .when(d == F.lit(float("inf")), F.lit("Infinity"))
        .when(d == F.lit(float("-inf")), F.lit("-Infinity"))
        .when(d == 0, F.lit("0"))
        .when((ad < 1e21) & (d == F.floor(d)), d.cast("decimal(38,0)").cast("string"))
        .when((ad < 1e17) & (ad >= 1e-6), plain_frac)
        .otherwise(F.lower(sci))
    )


def _variant_scalar_string(v: Column, kind: Column | None = None) -> Column:
    kind = F.schema_of_variant(v) if kind is None else kind
    as_str = F.try_variant_get(v, "$", "string")
    return (
        F.when(kind == "STRING", as_str)
        .when(kind == "BOOLEAN", as_str)
        .when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT)$"), as_str)
        .when(kind.rlike("^(DOUBLE|FLOAT|DECIMAL)"), js_number(F.try_variant_get(v, "$", "double")))
        .when(kind.startswith("OBJECT"), F.lit("[object Object]"))
        .when(kind == "VOID", F.lit(None).cast("string"))
        .otherwise(as_str)
    )


def js_string(v: Val) -> Column:
    """``String(v)`` for a non-null value; NULL when the value is null/undefined."""
    dt = v.dtype
    c = v.col
    if dt is None:
        return F.lit(None).cast("string")
    if isinstance(dt, T.StringType):
        return c
    if isinstance(dt, T.BooleanType):
        return c.cast("string")
    if isinstance(dt, _INTEGRAL):
        return c.cast("string")
    if isinstance(dt, _FRACTIONAL):
        return js_number(c)
    if isinstance(dt, T.TimestampType | T.TimestampNTZType):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(dt, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dt, (T.StructType, T.MapType)):
        return F.when(c.isNotNull(), F.lit("[object Object]"))
    if isinstance(dt, T.ArrayType):
        et = dt.elementType
        return F.array_join(F.transform(c, lambda e: js_string(Val(e, et))), ",", "")
    if isinstance(dt, T.VariantType):
        if v.text is not None:
            return v.text
        kind = variant_kind(v)
        arr = F.try_variant_get(c, "$", "array<variant>")
        joined = F.array_join(F.transform(arr, lambda e: _variant_scalar_string(e)), ",", "")
        return F.when(kind.startswith("ARRAY"), joined).otherwise(_variant_scalar_string(c, kind))
    return c.cast("string")


def is_js_string(v: Val) -> Column:
    """``typeof v === 'string'`` as a Column (static when typed)."""
    if v.dtype is None:
        return F.lit(False)
    if isinstance(v.dtype, T.StringType):
        return v.col.isNotNull()
    if isinstance(v.dtype, T.VariantType):
        return F.coalesce(variant_kind(v) == "STRING", F.lit(False))
    return F.lit(False)


def is_blank_text(s: Column) -> Column:
    return s.rlike(BLANK_RE)


def can_be_blank(v: Val) -> bool:
    """Only text (or dynamic values) can print as blank; numbers, booleans,
    dates and objects never do, so their blank test is statically false."""
    return isinstance(v.dtype, (T.StringType, T.VariantType, T.ArrayType))


def is_blank(v: Val) -> Column:
    """``v == null || String(v).trim() === ''`` without a regex where the type rules it out."""
    if v.dtype is None:
        return F.lit(True)
    if not can_be_blank(v):
        return v.col.isNull()
    text = js_string(v)
    return text.isNull() | (F.length(text) == 0) | text.rlike(BLANK_RE)


def json_text(v: Val) -> Column:
    """JSON encoding of a value as STRING (NULL for null/undefined)."""
    if v.dtype is None:
        return F.lit(None).cast("string")
    if isinstance(v.dtype, T.VariantType):
        return F.to_json(v.col)
    wrapped = F.to_json(F.array(v.col))
    return F.when(v.col.isNotNull(), wrapped.substr(F.lit(2), F.length(wrapped) - 2))


def type_cell(s: Column) -> Column:
    """C1 — CSV cell text to a VARIANT the way dynamic typing reads it:
    empty → null; true/TRUE/false/FALSE → boolean; numeric text → number
    (integral → bigint, else double) unless it lies beyond ±2^53, where a
    number would lose digits; anything else → string.  Date-only text stays a
    string, and so does a date-time, whose text is what a config formats."""
    num = s.rlike(r"^\s*-?(\d+\.?\d*([eE][-+]?\d+)?|\.\d+([eE][-+]?\d+)?)\s*$")
    integral = s.rlike(r"^\s*-?\d{1,18}\s*$")
    exact = F.abs(F.trim(s).try_cast("double")) < float(1 << 53)
    return (
        F.when(s.isNull() | (s == ""), F.lit(None).cast(T.VariantType()))
        .when(s.isin("true", "TRUE"), F.lit(True).cast(T.VariantType()))
        .when(s.isin("false", "FALSE"), F.lit(False).cast(T.VariantType()))
        .when(integral & exact, F.trim(s).try_cast("bigint").cast(T.VariantType()))
        .when(num & exact, F.trim(s).try_cast("double").cast(T.VariantType()))
        .otherwise(s.cast(T.VariantType()))
    )


# FHIR types whose stored text is returned as it is.
STRING_TYPES = (
    "date", "datetime", "instant", "time", "string", "code", "id", "markdown",
    "uri", "url", "canonical", "oid", "uuid",
)
# FHIR complex types stored as JSON text.
JSON_TYPES = (
    "address", "annotation", "attachment", "codeableconcept", "coding", "contactdetail",
    "contactpoint", "contributor", "datarequirement", "humanname", "identifier", "money",
    "parameterdefinition", "period", "quantity", "range", "ratio", "reference",
    "relatedartifact", "sampleddata", "signature", "timing", "triggerdefinition", "usagecontext",
)

_UNDEF = object()


def _parse_int_prefix(text: str) -> Any:
    import re

    m = re.match(r"^\s*([+-]?\d+)", text)
    return int(m.group(1)) if m else math.nan


def _parse_float_prefix(text: str) -> Any:
    import re

    m = re.match(r"^\s*([+-]?(?:Infinity|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?))", text)
    if not m:
        return math.nan
    t = m.group(1)
    return float(t.replace("Infinity", "inf"))


def parse_stored(value: str | None, fhir_type: str | None) -> Any:
    """C3 on the driver: stored text + FHIR type → Python value; ``_UNDEF`` when
    the reference yields undefined (null value/type or unparsable JSON)."""
    if value is None or fhir_type is None:
        return _UNDEF
    t = fhir_type.lower()
    if t == "boolean":
        return value.lower() == "true"
    if t in ("integer", "positiveint", "unsignedint"):
        return _parse_int_prefix(value)
    if t == "decimal":
        return _parse_float_prefix(value)
    if t in STRING_TYPES:
        return value
    if t in JSON_TYPES:
        try:
            return json.loads(value)
        except ValueError:
            return _UNDEF
    return value


def is_undef(v: Any) -> bool:
    return v is _UNDEF


def stored_value_column(value: Column, fhir_type: Column) -> Column:
    """C3 as a column: the parsed value rendered as JSON text (NULL = undefined)."""
    t = F.lower(fhir_type)
    int_txt = F.regexp_extract(value, r"^\s*([+-]?\d+)", 1)
    flt_txt = F.regexp_extract(value, r"^\s*([+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?))", 1)
    parsed_json = F.try_parse_json(value)
    return (
        F.when(value.isNull() | fhir_type.isNull(), F.lit(None).cast("string"))
        .when(t == "boolean", F.when(F.lower(value) == "true", "true").otherwise("false"))
        .when(t.isin("integer", "positiveint", "unsignedint"),
              F.when(int_txt == "", F.lit("null")).otherwise(int_txt.try_cast("decimal(38,0)").cast("string")))
        .when(t == "decimal", F.when(flt_txt == "", F.lit("null")).otherwise(js_number(flt_txt.try_cast("double"))))
        .when(t.isin(*STRING_TYPES), F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2))
        .when(t.isin(*JSON_TYPES), F.when(parsed_json.isNotNull(), F.to_json(parsed_json)))
        .otherwise(F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2))
    )


def is_missing(v: Val) -> Column:
    """What a path read treats as missing: SQL NULL, and a JSON null inside a VARIANT."""
    if v.dtype is None:
        return F.lit(True)
    if isinstance(v.dtype, T.VariantType):
        return v.col.isNull() | F.coalesce(F.is_variant_null(v.col), F.lit(False))
    return v.col.isNull()


def literal_val(value: Any) -> Val:
    """A Python JSON value as a typed literal Val (scalars typed, objects as VARIANT)."""
    if value is None:  # an explicit JSON null is written as null (the key stays)
        return Val(F.parse_json(F.lit("null")), T.VariantType())
    if isinstance(value, bool):
        return Val(F.lit(value), T.BooleanType())
    if isinstance(value, int):
        return Val(F.lit(value).cast("bigint"), T.LongType())
    if isinstance(value, float):
        return Val(F.lit(value).cast("double"), T.DoubleType())
    if isinstance(value, str):
        return Val(F.lit(value), T.StringType())
    return Val(F.parse_json(F.lit(json.dumps(value, separators=(",", ":"), ensure_ascii=False))), T.VariantType())
