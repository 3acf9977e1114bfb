"""Transformations (T1-T5) and the transformation registry.

A transformation is a Column builder, not a row function:

    fn(value: Val, details: JSON value, ctx: Context) -> (Val, message)

``message`` is a Column, NULL when the transformation succeeded — or a
function of the (bound) result Column, so an expensive result such as a date
parse is evaluated once and the message derived from it.  Registered names are
looked up upper-cased.  Users add their own with :func:`register_transformation`;
a builder may return a ``pandas_udf`` column when no native expression fits.
"""

from __future__ import annotations

import zlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.coerce import is_js_string, js_string, literal_val
from weft.functions.paths import Val, get_value
from weft.functions.patterns import date_format_pattern, date_parse_pattern, date_token_error, has_token

# Messages as the reference words them.
MSG_DATE_DETAILS = "Invalid details for DATE_FORMAT"
MSG_CASE_DETAILS = 'Invalid details for STRING_CASE (expected {case: "upper|lower"})'
MSG_DEFAULT_MISSING = "Missing 'value' in details for DEFAULT_VALUE"
MSG_LOOKUP_MAP = 'Invalid "map" object in details for CODE_LOOKUP'
MSG_CONCAT_DETAILS = "Invalid details or missing sourceItem for CONCATENATE"


@dataclass(frozen=True)
class Context:
    """What a transformation may see besides its value: the whole record.
    ``bound`` holds path reads the compiler already bound as columns."""

    record: Val
    bound: dict | None = None

    def read(self, path: str) -> Val:
        if self.bound and path in self.bound:
            return self.bound[path]
        return get_value(self.record, path)


Transformation = Callable[[Val, Any, Context], tuple[Val, Column]]

def _no_error() -> Column:
    return F.lit(None).cast("string")


def js_template(v: Any) -> str:
    """``${v}`` of a driver-side JSON value."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() and abs(v) < 1e21 else repr(v)
    if isinstance(v, dict):
        return "[object Object]"
    if isinstance(v, list):
        return ",".join("" if x is None else js_template(x) for x in v)
    return str(v)


def _truthy(v: Any) -> bool:
    return v not in (None, False, 0, "", 0.0)


def _as_variant(v: Val) -> Column:
    if isinstance(v.dtype, T.VariantType):
        return v.col
    if isinstance(v.dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.parse_json(F.to_json(v.col))
    return v.col.cast(T.VariantType())


def _same_shape(value: Val, new_text: Column) -> Val:
    """A string result that replaces a value only where it was a string."""
    if isinstance(value.dtype, T.StringType):
        return Val(new_text, T.StringType())
    if isinstance(value.dtype, T.VariantType):
        return Val(F.when(is_js_string(value), new_text.cast(T.VariantType())).otherwise(value.col), value.dtype)
    return value


def format_date(value: Val, details: Any, ctx: Context) -> tuple[Val, Column]:
    """Reformat a date string; non-strings and '' pass through."""
    d = details if isinstance(details, dict) else {}
    if not _truthy(d.get("inputFormat")) or not _truthy(d.get("outputFormat")):
        return value, F.lit(MSG_DATE_DETAILS)
    if value.undefined or not isinstance(value.dtype, (T.StringType, T.VariantType)):
        return value, _no_error()
    text = js_string(value)
    applies = is_js_string(value) & (text != "")
    source, target = str(d["inputFormat"]), str(d["outputFormat"])
    for pattern, formatting in ((source, False), (target, True)):
        bad = date_token_error(pattern, formatting)
        if bad:  # known before any record is read: an error of each record it applies to, not of the job
            return value, F.when(applies, F.lit(f"Error formatting date: unsupported token `{bad}` in `{pattern}`"))
    plain = F.regexp_replace(text, r"(\d)(?:st|nd|rd|th)", "$1") if has_token(source, "do") else text
    ts = F.try_to_timestamp(plain, F.lit(date_parse_pattern(source)))
    if has_token(source, "yy"):  # the year that ends so within fifty years from now
        ts = F.when(F.year(ts) > F.year(F.current_date()) + 50, F.add_months(ts, -1200).cast("timestamp") + (ts - ts.cast("date"))).otherwise(ts)
    ts = F.when(F.year(ts) <= 9999, ts)
    day = F.dayofmonth(ts)
    ending = F.when(day.between(11, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
    out = F.concat(*[F.concat(day.cast("string"), ending) if x == "do" else F.date_format(ts, x) for x in date_format_pattern(target)])

    def msg(result: Column) -> Column:
        # the parse runs once: a string that applied and came out null failed
        return F.when(applies & result.isNull(),
                      F.concat(F.lit("Failed to parse date '"), text, F.lit(f"' with format '{d['inputFormat']}'")))

    return _same_shape(value, F.when(applies, out).otherwise(text)), msg


def string_case(value: Val, details: Any, ctx: Context) -> tuple[Val, Column]:
    """upper/lower-case strings; anything else passes through."""
    if value.undefined or not isinstance(value.dtype, (T.StringType, T.VariantType)):
        return value, _no_error()
    case = details.get("case") if isinstance(details, dict) else None
    case = case.lower() if isinstance(case, str) else None
    if case not in ("upper", "lower"):
        return value, F.when(is_js_string(value), F.lit(MSG_CASE_DETAILS))
    text = js_string(value)
    return _same_shape(value, F.upper(text) if case == "upper" else F.lower(text)), _no_error()


def default_value(value: Val, details: Any, ctx: Context) -> tuple[Val, Column]:
    """The configured value (the caller applies it only to null/missing)."""
    if isinstance(details, dict) and "value" in details:
        return literal_val(details["value"]), _no_error()
    return value, F.lit(MSG_DEFAULT_MISSING)


def _common_literal_type(values: list[Any]) -> str:
    kinds = set()
    for v in values:
        if v is None:
            continue
        if isinstance(v, bool):
            kinds.add("bool")
        elif isinstance(v, int):
            kinds.add("int")
        elif isinstance(v, float):
            kinds.add("float")
        elif isinstance(v, str):
            kinds.add("str")
        else:
            kinds.add("json")
    if kinds <= {"str"}:
        return "str"
    if kinds <= {"int"}:
        return "int"
    if kinds <= {"int", "float"}:
        return "float"
    if kinds <= {"bool"}:
        return "bool"
    return "variant"


def _typed_lit(v: Any, kind: str) -> Column:
    if kind == "str":
        return F.lit(v).cast("string")
    if kind == "int":
        return F.lit(v).cast("bigint")
    if kind == "float":
        return F.lit(v).cast("double")
    if kind == "bool":
        return F.lit(v).cast("boolean")
    if v is None:
        return F.lit(None).cast(T.VariantType())
    return F.parse_json(F.lit(json.dumps(v, separators=(",", ":"), ensure_ascii=False)))


_KIND_TYPE = {
    "str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(),
    "bool": T.BooleanType(), "variant": T.VariantType(),
}


#: More codes than this are looked up by hash.
_WIDE_MAP = 32


def code_lookup(value: Val, details: Any, ctx: Context) -> tuple[Val, Column]:
    """Look the value's text up in the configured map.

    The map is configuration (bounded, driver-side), so it is compiled into a
    literal ``map`` expression — no join, no shuffle, whole-stage codegen."""
    d = details if isinstance(details, dict) else {}
    table = d.get("map")
    if not isinstance(table, (dict, list)) or table is None:
        return value, F.lit(MSG_LOOKUP_MAP)
    if isinstance(table, list):
        table = {str(i): v for i, v in enumerate(table)}
    has_default = "defaultValue" in d
    kind = _common_literal_type(list(table.values()) + ([d["defaultValue"]] if has_default else []))
    key = F.coalesce(js_string(value), F.lit("undefined"))
    values = list(table.values())
    if len(table) > _WIDE_MAP and kind != "variant" and None not in values:
        # codes lie in buckets by hash, so a look-up reads a few of them however many there are;
        # the buckets are one constant, read once when the plan is made
        buckets: list[dict] = [{} for _ in range(len(table) // 4)]
        for k, v in table.items():
            buckets[zlib.crc32(str(k).encode()) % len(buckets)][str(k)] = v
        schema = T.ArrayType(T.MapType(T.StringType(), _KIND_TYPE[kind]))
        m = F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False)), schema)
        hit = F.try_element_at(F.get(m, F.crc32(key.cast("binary")) % len(buckets)), key)
        found = hit.isNotNull()
    elif table:
        m = F.create_map(*[c for k, v in table.items() for c in (F.lit(str(k)), _typed_lit(v, kind))])
        found = F.map_contains_key(m, key)
        hit = F.try_element_at(m, key)
    else:
        found = F.lit(False)
        hit = _typed_lit(None, kind)
    dtype = _KIND_TYPE[kind]
    if has_default:
        out = F.when(found, hit).otherwise(_typed_lit(d["defaultValue"], kind))
        return Val(out, dtype), _no_error()
    msg = F.when(
        ~found,
        F.concat(F.lit("Value '"), key, F.lit("' not found in CODE_LOOKUP map and no defaultValue provided")),
    )
    return Val(hit, dtype), msg


def code_table_of(details: Any) -> str | None:
    """The name of the code table that a CODE_LOOKUP's details ask for, if they hold no map of their own."""
    d = details if isinstance(details, dict) else {}
    name = d.get("table")
    return name if isinstance(name, str) and not isinstance(d.get("map"), (dict, list)) else None


def table_lookup(key: Column, hit: Val, found: Column, details: dict) -> tuple[Val, list[Val], Column]:
    """J4 in a mapping: the value a join found for a code, or the default, or the error that T4 gives.

    Returns the hit, the default where there is one (the caller brings both to one type), and the message."""
    if "defaultValue" in details:
        return hit, [literal_val(details["defaultValue"])], _no_error()
    msg = F.when(~found, F.concat(F.lit("Value '"), key, F.lit("' not found in CODE_LOOKUP map and no defaultValue provided")))
    return hit, [], msg


def concatenate(value: Val, details: Any, ctx: Context) -> tuple[Val, Column]:
    """T5: join other fields of the record; missing ones count as ''."""
    d = details if isinstance(details, dict) else {}
    fields = d.get("fieldsToConcat")
    if not isinstance(fields, list):
        return value, F.lit(MSG_CONCAT_DETAILS)
    sep = d.get("separator")
    sep = "" if sep is None else js_template(sep)
    parts = [F.coalesce(js_string(ctx.read(str(p))), F.lit("")) for p in fields]
    if not parts:
        return Val(F.lit(""), T.StringType()), _no_error()
    return Val(F.concat_ws(sep, *parts), T.StringType()), _no_error()


_REGISTRY: dict[str, Transformation] = {}


def register_transformation(name: str, fn: Transformation) -> None:
    _REGISTRY[name.upper()] = fn


def lookup_transformation(name: str) -> Transformation | None:
    return _REGISTRY.get(name.upper())


def registered_transformations() -> list[str]:
    return sorted(_REGISTRY)


register_transformation("FORMAT_DATE", format_date)
register_transformation("STRING_CASE", string_case)
register_transformation("DEFAULT_VALUE", default_value)
register_transformation("CODE_LOOKUP", code_lookup)
register_transformation("CONCATENATE", concatenate)

__all__ = [
    "Context", "Transformation", "register_transformation", "lookup_transformation",
    "registered_transformations", "js_template", "_as_variant",
]
