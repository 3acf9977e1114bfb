"""Sinks (K1-K5, C6, A5).

All sinks keep results distributed: nothing is collected to the driver.  A
map-in/map-out result (``item``, ``errors``, ``original``) is written in one
pass; splitting into data and error outputs is a partition column, not two
recomputations.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _json_value(text: Column) -> Column:
    """JSON text → VARIANT so ``to_json`` prints it as a value, not a string."""
    return F.try_parse_json(text)


def error_object(errors: Column, original: Column) -> Column:
    """The reference's error item: ``{errors: [...], originalItem}``."""
    errs = F.transform(errors, lambda e: F.struct(
        e["fieldSourcePath"].alias("fieldSourcePath"), e["fieldTargetPath"].alias("fieldTargetPath"),
        _json_value(e["inputValue"]).alias("inputValue"), e["errorType"].alias("errorType"),
        e["message"].alias("message"), _json_value(e["details"]).alias("details")))
    # an unparsable original (malformed input) is kept as a JSON string
    orig = F.coalesce(_json_value(original), original.cast("variant"))
    return F.struct(errs.alias("errors"), orig.alias("originalItem"))


def tagged(result: DataFrame) -> DataFrame:
    """K1 columns: ``type`` ('data' | 'error') and ``line`` (one JSON text per item)."""
    is_err = F.size("errors") > 0
    kind = F.when(is_err, F.lit("error")).otherwise(F.lit("data"))
    line = F.when(
        is_err,
        F.to_json(F.struct(F.lit("error").alias("type"), error_object(F.col("errors"), F.col("original")).alias("error"))),
    ).otherwise(F.to_json(F.struct(F.lit("data").alias("type"), F.col("item").alias("item"))))
    return result.select(kind.alias("type"), line.alias("line"))


def write_ndjson(result: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1: tagged NDJSON text."""
    tagged(result).select("line").write.mode(mode).text(path)


def write_split(result: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2: data and error outputs in one pass (``type=data`` / ``type=error`` folders)."""
    tagged(result).write.mode(mode).partitionBy("type").text(path)


def split(result: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K2 as two lazy DataFrames (for callers that write them to different sinks)."""
    ok = F.size("errors") == 0
    return result.where(ok).select("item"), result.where(~ok).select("errors", "original")


def error_summary(result: DataFrame) -> DataFrame:
    """A5 reporting view: error counts by type and target path (partial aggregation
    before the shuffle; the group count is bounded by the config, not the data)."""
    return (result.where(F.size("errors") > 0).select(F.explode("errors").alias("e"))
            .groupBy(F.col("e.errorType").alias("errorType"), F.col("e.fieldTargetPath").alias("fieldTargetPath"))
            .agg(F.count(F.lit(1)).alias("n")))


def counted(result: DataFrame) -> tuple[DataFrame, Observation]:
    """A2: the same rows, and an observation that holds the counts of the run once these have been written.

    ``records``, and where the rows are a mapping's result ``data``, ``errors`` (records with any) and ``field_errors``.  They are counted as rows
    go by, so no second job is run.  They hold for one action over the rows; an action that stops early
    (``first``, ``limit``) counts what it read.  A task that is run again counts once, as long as no shuffle comes after.
    """
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("records")]
    if "errors" in result.columns:
        n = F.coalesce(F.size("errors"), F.lit(0))
        counts += [F.count_if(n <= 0).alias("data"), F.count_if(n > 0).alias("errors"), F.coalesce(F.sum(F.greatest(n, F.lit(0))), F.lit(0)).cast("bigint").alias("field_errors")]
    return result.observe(seen, *counts), seen


def flatten_columns(col: Column, dtype: T.DataType, prefix: str) -> list[Column]:
    """Nested struct leaves as dotted columns; arrays joined with ';'."""
    if isinstance(dtype, T.StructType):
        out = []
        for f in dtype.fields:
            out += flatten_columns(col.getField(f.name), f.dataType, f"{prefix}.{f.name}" if prefix else f.name)
        return out
    if isinstance(dtype, T.ArrayType):
        et = dtype.elementType
        if isinstance(et, (T.StructType, T.MapType)):
            txt = F.transform(col, lambda x: F.when(x.isNotNull(), F.lit("[object Object]")))
        else:
            from weft.functions.coerce import js_string
            from weft.functions.paths import Val

            txt = F.transform(col, lambda x: js_string(Val(x, et)))
        return [F.array_join(txt, ";", "").alias(prefix)]
    if isinstance(dtype, T.VariantType):
        return [F.to_json(col).alias(prefix)]
    return [col.alias(prefix)]


def flatten(df: DataFrame, item_col: str = "item") -> DataFrame:
    """K3 body: one flat column per leaf of the item struct."""
    dt = df.schema[item_col].dataType
    return df.select(*flatten_columns(F.col(item_col), dt, ""))


def _is_dynamic(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_is_dynamic(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.VariantType)


def leaf_paths(item: Any, prefix: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """The keys that lead to each leaf (anything but an object) of a parsed JSON value; an empty object has none."""
    if isinstance(item, dict):
        return [p for k, v in item.items() for p in leaf_paths(v, (*prefix, k))]
    return [prefix]


def leaf_text(value: Column) -> Column:
    """C6 for one VARIANT value: a scalar's text, an array's elements joined with ';'; nothing for an object, whose leaves have longer names."""
    from weft.functions.coerce import js_string
    from weft.functions.paths import Val

    kind = F.schema_of_variant(value)
    elements = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda e: js_string(Val(e, T.VariantType())))
    return F.when(kind.startswith("ARRAY"), F.array_join(elements, ";", "")).when(~kind.startswith("OBJECT"), js_string(Val(value, T.VariantType())))


def flatten_dynamic(items: DataFrame, item_col: str, paths: list[tuple[str, ...]]) -> DataFrame:
    """One text column per name of ``paths``, keys joined with dots; of paths with one name the last that a record has counts.

    Records lack a name that is an object with them, or isn't there; what they have besides is left out.  Items that are not objects are skipped.
    """
    from weft.functions.paths import variant_at

    names: dict[str, list[tuple[str, ...]]] = {}
    for p in paths:
        names.setdefault(".".join(p), []).insert(0, p)
    item = F.col(f"`{item_col}`")
    columns = [F.coalesce(*[leaf_text(variant_at(item, p)) for p in own]).alias(name) for name, own in names.items()]
    return items.where(F.schema_of_variant(item).startswith("OBJECT")).select(*columns)


def write_csv_dynamic(result: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite", first_by: str | None = None) -> None:
    """K3 where items are, or hold, VARIANT: the first data record's leaves are the header, all others are cut to it.

    The first record is the one with the least ``first_by``, else the first that Spark reads.  Only that record comes to the driver; rows
    are read by the header's paths in the JVM.  The keys of a VARIANT object come in the order it keeps them, by name.
    ``columns`` restricts and orders the header, with blank cells for names the first record lacks.  No data record, or a first one without a leaf:
    an empty file.  Names that differ in case only can't be columns of one file: ``ValueError``.
    """
    ok = result.where(F.size("errors") == 0)
    item, dtype = F.col("item"), result.schema["item"].dataType
    value = item if isinstance(dtype, T.VariantType) else F.parse_json(F.to_json(item))
    objects = ok.where(item.isNotNull()).where(F.schema_of_variant(value).startswith("OBJECT"))
    text = F.to_json(item).alias("j")
    first = objects.agg(F.min_by(text, F.col(f"`{first_by}`")).alias("j")).first() if first_by else objects.select(text).first()
    paths = leaf_paths(json.loads(first.j)) if first and first.j else []
    if columns is not None:
        paths = [p for c in columns for p in ([p for p in paths if ".".join(p) == c] or [(c,)])] if paths else []
    names = {".".join(p) for p in paths}
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"names that differ in case only: {sorted(names)}")
    if not paths:
        result.select(F.lit("").alias("value")).limit(0).write.mode(mode).text(path)
        return
    flat = flatten_dynamic(ok.select(value.alias("item")), "item", paths)
    if len(names) == 1:  # a blank line is no row
        flat = flat.where(F.trim(F.col(f"`{flat.columns[0]}`")) != "")
    _csv(flat, path, mode)


def _csv(flat: DataFrame, path: str, mode: str) -> None:
    # quotes are doubled, blank texts stay blank and white space is kept, as spreadsheets write CSV
    options = {"header": True, "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    flat.write.mode(mode).options(**options).csv(path)


def write_csv(result: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    """K3: data items flattened to CSV with a header; error items skipped.
    ``columns`` restricts/orders the header (the reference takes it from the
    first record; here the schema gives it deterministically).  Items that are, or hold, VARIANT go
    to :func:`write_csv_dynamic`."""
    from weft.functions.coerce import js_number

    if _is_dynamic(result.schema["item"].dataType):
        return write_csv_dynamic(result, path, columns, mode)
    flat = flatten(result.where(F.size("errors") == 0))
    flat = flat.select(*[js_number(F.col(f"`{f.name}`")).alias(f.name) if f.dataType in (T.DoubleType(), T.FloatType()) else F.col(f"`{f.name}`")
                         for f in flat.schema.fields])
    if columns is not None:
        flat = flat.select(*[F.col(f"`{c}`") if c in flat.columns else F.lit(None).cast("string").alias(c)
                             for c in columns])
    _csv(flat, path, mode)


def pretty_json(col: Column) -> Column:
    """K4: 2-space indented JSON text (Jackson prints ``"a" : 1``)."""
    return F.to_json(col, {"pretty": "true"})


def push_plan(items: DataFrame, resource_type: str, base_url: str, method: str = "POST",
              item_col: str = "item", keep: tuple[str, ...] = ()) -> DataFrame:
    """K5 request planning: ``method``, ``url``, ``body`` per resource.  PUT needs
    an id (idempotent on retry); without one it falls back to POST."""
    rid = F.col(f"{item_col}.id") if "id" in items.schema[item_col].dataType.fieldNames() else F.lit(None)
    rid_txt = rid.cast("string")
    put = (F.lit(method.upper()) == "PUT") & rid_txt.isNotNull() & (rid_txt != "")
    eff = F.when(put, F.lit("PUT")).otherwise(F.lit("POST"))
    url = F.when(put, F.concat(F.lit(f"{base_url}/{resource_type}/"), rid_txt)).otherwise(F.lit(f"{base_url}/{resource_type}"))
    return items.select(*[F.col(c) for c in keep], eff.alias("method"), url.alias("url"),
                        F.to_json(F.col(item_col)).alias("body"))


def push(plan: DataFrame, sender: Callable[[str, str, str], tuple[int, str | None]]) -> DataFrame:
    """K5 sending: ``sender(method, url, body) -> (status, error)`` runs inside the
    tasks over Arrow batches; the outcome of every request is a row.  Task retry
    may resend a batch, so plan with PUT + id where duplicates matter."""

    def run(batches):
        for pdf in batches:
            status, err = [], []
            for m, u, b in zip(pdf["method"], pdf["url"], pdf["body"]):
                try:
                    s, e = sender(m, u, b)
                except Exception as ex:  # the outcome table records it
                    s, e = None, str(ex)
                status.append(s)
                err.append(e)
            yield pdf.assign(status=pd.array(status, dtype="Int32"), error=err)

    return plan.mapInPandas(run, "method string, url string, body string, status int, error string")
