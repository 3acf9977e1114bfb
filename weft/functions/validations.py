"""Validations (V1-V5) and the validation registry.

A validation is ``fn(value: Val, details, ctx) -> Column`` giving the error
message, NULL when valid.  The gate (V6) lives in the compiler: REQUIRED
always runs, the others only on non-null, non-blank values.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.coerce import is_blank, js_string
from weft.functions.paths import Val
from weft.functions.patterns import js_regex_to_java, regex_error
from weft.functions.transforms import Context, js_template

# Messages as the reference words them.
MSG_REQUIRED = "Value is required but was missing or empty."
MSG_REGEX_MISSING = "Configuration error: Missing regex pattern."
MSG_MIN_CONFIG = 'Configuration error: Missing/invalid "min" number.'
MSG_VALUESET_CONFIG = "Configuration error: Missing ValueSet URL."
MSG_NOT_IN_VALUESET = "Value '{value}' is not valid according to ValueSet '{url}'."
MSG_MAX_CONFIG = "Configuration error: Missing max length."

Validation = Callable[[Val, Any, Context], Column]


def utf16_length(s: Column) -> Column:
    """``String(v).length``: UTF-16 code units, not code points.  ASCII text
    (byte count == char count, an O(1) test on the byte side) skips the re-encode."""
    n = F.length(s)
    return F.when(F.octet_length(s) == n, n).otherwise((F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int"))


def required(value: Val, details: Any, ctx: Context) -> Column:
    return F.when(is_blank(value), F.lit(MSG_REQUIRED))


def regex(value: Val, details: Any, ctx: Context) -> Column:
    d = details if isinstance(details, dict) else {}
    pattern = d.get("pattern")
    if pattern in (None, "", False, 0):
        return F.lit(MSG_REGEX_MISSING)
    pattern = js_template(pattern)
    err = regex_error(pattern)
    text = js_string(value)
    if err is not None:
        return F.when(text.isNotNull(), F.lit(f"Configuration error: Invalid regex pattern /{pattern}/ ({err})."))
    custom = d.get("message")
    if custom not in (None, "", False, 0):
        msg = F.lit(js_template(custom))
    else:
        msg = F.concat(F.lit("Value '"), text, F.lit(f"' does not match pattern /{pattern}/."))
    return F.when(text.isNotNull() & ~text.rlike(js_regex_to_java(pattern)), msg)


def _number(details: Any, key: str) -> float | int | None:
    v = details.get(key) if isinstance(details, dict) else None
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return None
    return v


def min_length(value: Val, details: Any, ctx: Context) -> Column:
    n = _number(details, "min")
    if n is None:
        return F.lit(MSG_MIN_CONFIG)
    text = js_string(value)
    length = utf16_length(text)
    return F.when(
        text.isNotNull() & (length < F.lit(n)),
        F.concat(F.lit("Value length ("), length.cast("string"),
                 F.lit(f") is less than minimum required ({js_template(n)}).")),
    )


def max_length(value: Val, details: Any, ctx: Context) -> Column:
    """V5 — present in the reference only outside its live registry; opt-in."""
    n = _number(details, "max")
    if n is None:
        return F.lit(MSG_MAX_CONFIG)
    text = js_string(value)
    length = utf16_length(text)
    return F.when(
        text.isNotNull() & (length > F.lit(n)),
        F.concat(F.lit("Value length ("), length.cast("string"),
                 F.lit(f") exceeds maximum allowed ({js_template(n)}).")),
    )


def valueset(value: Val, details: Any, ctx: Context) -> Column:
    """V4 — needs a ValueSet URL; membership itself is always accepted."""
    d = details if isinstance(details, dict) else {}
    if d.get("valueSetUrl") in (None, "", False, 0):
        return F.lit(MSG_VALUESET_CONFIG)
    return F.lit(None).cast("string")


def value_set_of(details: Any) -> str | None:
    """The url of the value set that a VALUESET's details name."""
    url = details.get("valueSetUrl") if isinstance(details, dict) else None
    return url if isinstance(url, str) and url else None


def not_in_value_set(text: Column, found: Column, url: str) -> Column:
    """V4 against a table: the message for a value that a join didn't find among a set's codes."""
    before, after = MSG_NOT_IN_VALUESET.replace("{url}", url).split("{value}", 1)
    return F.when(~found, F.concat(F.lit(before), text, F.lit(after)))


_REGISTRY: dict[str, Validation] = {}


def register_validation(name: str, fn: Validation) -> None:
    _REGISTRY[name.upper()] = fn


def lookup_validation(name: str) -> Validation | None:
    return _REGISTRY.get(name.upper())


@contextmanager
def extended_validations():
    """Opt-in for the plans compiled inside the block: MAX_LENGTH, the one
    validation the reference defines outside its live registry.  Outside the
    block the name stays "not registered", as in the reference."""
    had = _REGISTRY.get("MAX_LENGTH")
    register_validation("MAX_LENGTH", max_length)
    try:
        yield
    finally:
        if had is None:
            _REGISTRY.pop("MAX_LENGTH", None)
        else:
            _REGISTRY["MAX_LENGTH"] = had


register_validation("REQUIRED", required)
register_validation("REGEX", regex)
register_validation("MIN_LENGTH", min_length)
register_validation("VALUESET", valueset)
