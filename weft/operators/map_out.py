"""Map-out (P15, P16, F1, F2): resources → flat or nested records.

No validation or transformation runs in this direction.  A resource of the
wrong type becomes an error record (F1); a resource that maps to nothing is
dropped (F2).  For a CSV target each mapping names a column (the first dot
segment of its path, later mappings win); for a JSON target the path is a
plain nested set where numeric segments make arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.coerce import js_string, json_text
from weft.functions.paths import Val, get_value, parse_path, column
from weft.operators.map_in import ERROR_TYPE, error_struct, original_json, record_root
from weft.plans.config import MappingConfig
from weft.plans.tree import TargetTree, _combine


@dataclass
class MapOutPlan:
    df: DataFrame
    item_type: T.StructType

    @property
    def data(self) -> DataFrame:
        return self.df.where(F.size("errors") == 0).drop("errors", "original")

    @property
    def errors(self) -> DataFrame:
        return self.df.where(F.size("errors") > 0).drop("item")


def _resource_type_text(root: Val) -> tuple:
    rt = get_value(root, "resourceType")
    if rt.undefined:
        return rt, F.lit("undefined")
    if root.is_variant:
        raw = F.try_variant_get(root.col, '$["resourceType"]', "variant")
        shown = F.when(raw.isNull(), F.lit("undefined")).when(F.is_variant_null(raw), F.lit("null")).otherwise(js_string(rt))
        return rt, shown
    return rt, F.coalesce(js_string(rt), F.lit("undefined"))


def map_out(df: DataFrame, cfg: MappingConfig, variant_col: str | None = None,
            keep: tuple[str, ...] = (), keep_original: bool = True) -> MapOutPlan:
    root = record_root(df, variant_col)
    rt, shown = _resource_type_text(root)
    expected = cfg.resource_type or ""
    if rt.undefined:
        type_ok = F.lit(False)
    else:
        type_ok = F.coalesce((js_string(rt) == F.lit(expected)) & (
            F.schema_of_variant(rt.col) == "STRING" if rt.is_variant else F.lit(isinstance(rt.dtype, T.StringType))
        ), F.lit(False))
    f1 = error_struct(None, "N/A", json_text(root), "Validation",
                      F.concat(F.lit(f"Expected '{expected}', got '"), shown, F.lit("'. Skipping.")), None)
    csv = (cfg.source_type or "").upper() == "CSV"
    present_terms = []
    if csv:
        columns: dict[str, list[Val]] = {}
        for m in cfg.mappings:
            if not m.source_path or not m.target_path:  # F7
                continue
            v = get_value(root, m.target_path)
            if v.undefined:
                continue
            name = m.source_path.split(".")[0] or m.source_path
            columns.setdefault(name, []).append(v)
        parts = []
        for name, vals in columns.items():
            vals = _combine(vals)
            col = F.coalesce(*[v.col for v in reversed(vals)]) if len(vals) > 1 else vals[0].col
            parts.append((name, Val(col, vals[0].dtype)))
            present_terms.append(col.isNotNull())
        if parts:
            st = T.StructType([T.StructField(n, v.dtype) for n, v in parts])
            item = Val(F.struct(*[v.col.alias(n) for n, v in parts]), st)
        else:
            item = Val(F.struct(F.lit(None).cast("string").alias("_empty")),
                       T.StructType([T.StructField("_empty", T.StringType())]))
    else:
        tree = TargetTree((), expected, heuristics=False)
        for i, m in enumerate(cfg.mappings):
            if not m.source_path or not m.target_path:
                continue
            v = get_value(root, m.target_path)
            if v.undefined:
                continue
            tree.set(parse_path(m.source_path), v, v.col.isNotNull(), i)
        item = tree.build()
        p = tree.present()
        if p is not None:
            present_terms.append(p)
    present = F.lit(False)
    for t in present_terms:
        present = present | t
    errors = F.when(type_ok, F.array().cast(T.ArrayType(ERROR_TYPE))).otherwise(F.array(f1))
    orig = original_json(df, variant_col) if keep_original else F.lit(None).cast("string")
    out = (
        df.select(*[column(c) for c in keep],
                  F.when(type_ok, item.col).alias("item"), errors.alias("errors"),
                  F.when(~type_ok, orig).alias("original"), (type_ok & present).alias("_present"))
        .where(~type_ok | F.col("_present"))  # F2
        .drop("_present")
    )
    return MapOutPlan(out, item.dtype)
