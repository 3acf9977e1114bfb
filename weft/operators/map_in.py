"""Map-in (P13): records → resources, with a data side and an error side.

The whole per-record fold of the reference (get → default → validate →
transform → set, then auto-fill and mandatory check) is compiled on the
driver into three projections, so a run is one narrow, shuffle-free stage:

1. ``_v<i>``  — the source value of field mapping *i* (a path read);
2. ``_t<i>``, ``_e<i>`` — the value to write and the field error, if any;
3. ``item`` (the nested resource), ``errors`` (all field errors, in mapping
   order) and ``original`` (the input record as JSON, only on error rows).

Binding the intermediate values as columns keeps each expression referenced
from several places (gate, message, write) evaluated once.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.coerce import is_blank, is_missing, is_undef, js_string, json_text, literal_val, parse_stored
from weft.functions.paths import Val, base_path, get_path, get_value, parse_path, column
from weft.functions.transforms import Context, code_table_of, lookup_transformation, table_lookup
from weft.functions.validations import lookup_validation, not_in_value_set, value_set_of
from weft.operators.lookup import distinct_codes, value_set_codes
from weft.plans.config import MappingConfig, Profile
from weft.plans.tree import TargetTree, _combine

ERROR_TYPE = T.StructType(
    [
        T.StructField("fieldSourcePath", T.StringType()),
        T.StructField("fieldTargetPath", T.StringType()),
        T.StructField("inputValue", T.StringType()),  # JSON text of the value
        T.StructField("errorType", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("details", T.StringType()),  # JSON text
    ]
)
ERRORS_TYPE = T.ArrayType(ERROR_TYPE)

# Texts of the record-level checks.
POSTCHECK_SOURCE = "N/A (FHIR Profile Post-check)"
SYSTEM_TARGET = "N/A (System Error)"
MSG_NO_TYPE = "Unexpected system error: Cannot read properties of undefined (reading 'toLowerCase')"
ROOT_PATH = "$ROOT"


def error_struct(source, target, input_json, etype, message, details) -> Column:
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x).cast("string")

    return F.struct(
        lit(source).alias("fieldSourcePath"),
        lit(target).alias("fieldTargetPath"),
        lit(input_json).alias("inputValue"),
        lit(etype).alias("errorType"),
        lit(message).alias("message"),
        lit(details).alias("details"),
    )


def _dumps(v) -> str:
    return json.dumps(v, separators=(",", ":"), ensure_ascii=False)


CORRUPT = "_corrupt_record"
MSG_MALFORMED = "Unexpected system error: malformed input record"


def _record_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != CORRUPT]


def record_root(df: DataFrame, variant_col: str | None = None) -> Val:
    """The whole input record as a Val: the VARIANT column, or a struct of all columns."""
    if variant_col is not None:
        return Val(F.col(variant_col), T.VariantType())
    cols = _record_columns(df)
    return Val(F.struct(*[column(c) for c in cols]), T.StructType([df.schema[c] for c in cols]))


def original_json(df: DataFrame, variant_col: str | None = None) -> Column:
    if variant_col is not None:
        return F.to_json(F.col(variant_col))
    return F.to_json(F.struct(*[column(c) for c in _record_columns(df)]))


@dataclass
class MapInPlan:
    """Output of :func:`map_in`: ``df`` has ``item``, ``errors``, ``original``
    plus the requested pass-through columns."""

    df: DataFrame
    item_type: T.StructType

    @property
    def data(self) -> DataFrame:
        return self.df.where(F.size("errors") == 0).drop("errors", "original")

    @property
    def errors(self) -> DataFrame:
        return self.df.where(F.size("errors") > 0).drop("item")


def map_in(
    df: DataFrame,
    cfg: MappingConfig,
    profile: Profile = Profile(),
    variant_col: str | None = None,
    keep: tuple[str, ...] = (),
    keep_original: bool = True,
    code_tables: dict[str, DataFrame] | None = None,
    value_sets: DataFrame | None = None,
) -> MapInPlan:
    """Compile ``cfg`` against ``df``'s schema and apply it (one narrow stage).

    ``code_tables``: tables (``code``, ``value``) that CODE_LOOKUPs name by ``{"table": name}`` in
    place of a map.  Each such mapping is a left join by the value's text, before
    values are transformed, so codes never become part of the plan; a code that isn't there is
    the default or the field's error, as with a map.

    ``value_sets``: a table (``url``, ``code``); a VALUESET's value must be the text of a code of its set, or is
    the field's error, whatever the strength.  A set that the table has no code of accepts every value, as all do without a table.
    """
    cols = list(df.columns)
    root = record_root(df, variant_col)
    rt = cfg.resource_type or ""
    ctx = Context(record=root)

    # ---- stage 1: source values
    s1 = []
    raw: dict[int, Val] = {}
    live = [(i, m) for i, m in enumerate(cfg.mappings) if m.target_path]  # F7
    def bind(name: str, v: Val, probe: bool = True) -> Val:
        s1.append(v.col.alias(name))
        if probe and isinstance(v.dtype, T.VariantType):  # the type probe and the text are bound once too
            s1.append(F.schema_of_variant(F.col(name)).alias(f"{name}_k"))
            kinded = Val(F.col(name), v.dtype, F.col(f"{name}_k"))
            s1.append(js_string(kinded).alias(f"{name}_s"))
            return Val(F.col(name), v.dtype, F.col(f"{name}_k"), F.col(f"{name}_s"))
        return Val(F.col(name), v.dtype)

    for i, m in live:
        v = root if m.source_path == ROOT_PATH else get_value(root, m.source_path or "")
        # a plain copy (no validation or transformation) never needs the value's text
        used = bool(m.validation_type or m.transformation_type)
        raw[i] = v if v.undefined else bind(f"_v{i}", v, probe=used)
    # paths other mappings read from the record (CONCATENATE) are bound as well
    bound: dict[str, Val] = {}
    for i, m in live:
        d = m.transformation_details
        if m.transformation == "CONCATENATE" and isinstance(d, dict) and isinstance(d.get("fieldsToConcat"), list):
            for p in d["fieldsToConcat"]:
                p = str(p)
                if p not in bound:
                    v = get_value(root, p)
                    bound[p] = v if v.undefined else bind(f"_c{len(bound)}", v)
    # codes held in tables: the value's text is bound as a key and joined
    looked: dict[int, DataFrame] = {}
    for i, m in live:
        name = code_table_of(m.transformation_details) if m.transformation == "CODE_LOOKUP" else None
        if name in (code_tables or {}):
            looked[i] = code_tables[name]
    df1 = df.select(*[column(c) for c in cols], *s1)
    if looked:
        keys = [F.coalesce(js_string(raw[i]), F.lit("undefined")).alias(f"_k{i}") for i in looked]
        df1 = df1.select("*", *keys)
        tables = {id(t): distinct_codes(t) for t in looked.values()}
        for i, t in looked.items():
            codes = tables[id(t)].select(F.col("_lk").alias(f"_lk{i}"), F.col("_lv").alias(f"_l{i}"))
            df1 = df1.join(codes, F.col(f"_k{i}") == F.col(f"_lk{i}"), "left")
    root1 = record_root(df, variant_col)
    ctx = Context(record=root1, bound=bound)

    # ---- stage 2: value after default, transformed value (bound once each)
    s2 = []
    plans: dict[int, dict] = {}
    fired_static: dict[int, bool] = {}
    for i, m in live:
        src, tgt = m.source_path, m.target_path
        v = raw[i]
        tname = m.transformation
        is_default = tname == "DEFAULT_VALUE"
        pl: dict = {"v": v, "src": src, "tgt": tgt}
        val = v
        if is_default:
            fn = lookup_transformation("DEFAULT_VALUE")
            missing = F.lit(True) if v.undefined else v.col.isNull()
            pl["missing"] = missing
            if fn is None:
                pl["default_err"] = (missing, F.lit("DEFAULT_VALUE function not registered."), None)
            else:
                dv, msg = fn(v, m.transformation_details, ctx)
                det = _dumps({"type": "DEFAULT_VALUE", "details": m.transformation_details})
                pl["default_err"] = (missing & msg.isNotNull(), msg, det)
                if v.undefined:
                    val = dv
                elif dv.dtype is not None:
                    a_, b_ = _combine([v, dv])
                    val = Val(F.when(missing, b_.col).otherwise(a_.col), a_.dtype)
            fired_static[i] = isinstance(m.transformation_details, dict) and "value" in m.transformation_details
            if not val.undefined:
                s2.append(val.col.alias(f"_d{i}"))
                val = Val(F.col(f"_d{i}"), val.dtype)
        pl["val"] = val
        final = val
        if i in looked:
            found = F.col(f"_lk{i}").isNotNull()
            hit, other, tmsg = table_lookup(F.col(f"_k{i}"), Val(F.col(f"_l{i}"), looked[i].schema["value"].dataType), found, m.transformation_details)
            if other:
                a_, b_ = _combine([hit, *other])
                hit = Val(F.when(found, a_.col).otherwise(b_.col), a_.dtype)
            final, pl["tmsg"] = hit, tmsg
            pl["t_det"] = _dumps({"type": m.transformation_type, "details": m.transformation_details})
        elif tname and not is_default:
            fn = lookup_transformation(tname)
            if tname == "CODE_LOOKUP" and code_table_of(m.transformation_details):
                tval, tmsg = val, F.lit(f"Code table '{code_table_of(m.transformation_details)}' is not known to this run.")
                pl["t_det"] = _dumps({"type": m.transformation_type, "details": m.transformation_details})
            elif fn is not None:
                tval, tmsg = fn(val, m.transformation_details, ctx)
                pl["t_det"] = _dumps({"type": m.transformation_type, "details": m.transformation_details})
            else:
                tval = val
                tmsg = F.lit(f"Transformation function '{m.transformation_type}' not registered.")
                pl["t_det"] = None
            pl["tmsg"] = tmsg
            final = tval
        if not final.undefined:
            s2.append(final.col.alias(f"_t{i}"))
            final = Val(F.col(f"_t{i}"), final.dtype)
        pl["final"] = final
        plans[i] = pl
    bound_cols = [n for n in df1.columns if n not in cols]
    df2a = df1.select(*[column(c) for c in cols], *[F.col(n) for n in bound_cols], *s2)

    # values that must be in a set meet its codes
    member: dict[int, str] = {}
    if value_sets is not None:
        for i, m in live:
            if (m.validation_type or "").upper() == "VALUESET" and value_set_of(m.validation_details) and not plans[i]["val"].undefined:
                member[i] = value_set_of(m.validation_details)
        sets = value_set_codes(value_sets, set(member.values())) if member else {}
        member = {i: url for i, url in member.items() if url in sets}
        df2a = df2a.select("*", *[F.coalesce(js_string(plans[i]["val"]), F.lit("")).alias(f"_vk{i}") for i in member])
        for i, url in member.items():
            codes = sets[url].select(F.col("_lk").alias(f"_vm{i}"))
            df2a = df2a.join(codes, F.col(f"_vk{i}") == F.col(f"_vm{i}"), "left")

    # ---- stage 2b: one error struct per field mapping (first failing step wins)
    s3 = []
    finals: dict[int, Val] = {}
    for i, m in live:
        pl = plans[i]
        src, tgt, v, val = pl["src"], pl["tgt"], pl["v"], pl["val"]
        err_cases: list[tuple[Column, Column]] = []
        ok = F.lit(True)
        if "default_err" in pl:
            cond, msg, det = pl["default_err"]
            err_cases.append((cond, error_struct(src, tgt, json_text(v), "Transformation", msg, det)))
            ok = ~cond
        if m.validation_type:
            vname = m.validation_type.upper()
            gate = F.lit(True) if vname == "REQUIRED" else ~is_blank(val)
            fn = lookup_validation(vname)
            if fn is not None:
                vmsg = fn(val, m.validation_details, ctx)
                if i in member:
                    vmsg = F.coalesce(vmsg, not_in_value_set(F.col(f"_vk{i}"), F.col(f"_vm{i}").isNotNull(), member[i]))
                det = _dumps({"type": m.validation_type, "details": m.validation_details})
            else:
                vmsg = F.lit(f"Validation function '{m.validation_type}' not registered.")
                det = None
            vfail = ok & gate & vmsg.isNotNull()
            err_cases.append((vfail, error_struct(src, tgt, json_text(val), "Validation", vmsg, det)))
            ok = ok & ~vfail
        if "tmsg" in pl:
            tmsg = pl["tmsg"]
            if callable(tmsg):
                tmsg = tmsg(pl["final"].col) if not pl["final"].undefined else F.lit(None).cast("string")
            tfail = ok & tmsg.isNotNull()
            err_cases.append((tfail, error_struct(src, tgt, json_text(val), "Transformation", tmsg, pl["t_det"])))
        if err_cases:
            e = None
            for cond, st in err_cases:
                e = F.when(cond, st) if e is None else e.when(cond, st)
            s3.append(e.alias(f"_e{i}"))
        else:
            s3.append(F.lit(None).cast(ERROR_TYPE).alias(f"_e{i}"))
        if not pl["final"].undefined:
            finals[i] = pl["final"]
    df2 = df2a.select(*[column(c) for c in cols], *[F.col(f"_t{i}") for i in finals], *s3)

    # ---- stage 3: assemble the resource and collect errors
    tree = TargetTree(profile.complete, rt)
    if cfg.definition_url:
        tree.set(parse_path("meta.profile[0]"), Val(F.lit(cfg.definition_url), T.StringType()), F.lit(True), -1)
    mapped: dict[str, list[Column]] = {}
    for i, m in live:
        if i not in finals:
            if fired_static.get(i):
                fin = literal_val(None)
            else:
                continue
        else:
            fin = finals[i]
        fired = F.lit(True) if fired_static.get(i) else fin.col.isNotNull()
        tree.set(parse_path(m.target_path), fin, fired, i)
        mapped.setdefault(base_path(m.target_path), []).append(fired)

    sys_error: Column | None = None
    has_profile = bool(profile.complete)
    if has_profile and profile.fill:
        for k, el in enumerate(profile.fill):
            ordinal = 100_000 + k
            rel = el.path[len(rt) + 1:]
            if not rel or el.path == rt:
                continue
            pb = base_path(rel)
            before = tree.build(cutoff=ordinal)
            read = get_path(before, parse_path(rel))
            present_terms = list(mapped.get(pb, []))
            if not read.undefined:
                present_terms.append(~is_missing(read))
            present = F.lit(False)
            for t in present_terms:
                present = present | F.coalesce(t, F.lit(False))
            dt0 = el.data_types[0] if el.data_types else None
            if el.fixed_value is not None:
                ftype = el.fixed_type or dt0
                raw_value = el.fixed_value
            elif el.default_value is not None:
                ftype = el.default_type or dt0
                raw_value = el.default_value
            else:
                continue
            if not ftype:
                term = ~present
                sys_error = term if sys_error is None else sys_error | term
                continue
            value = parse_stored(raw_value, ftype)
            if is_undef(value):
                continue
            cond = ~present
            tree.set(parse_path(rel), literal_val(value), cond, ordinal)
            mapped.setdefault(pb, []).append(cond)

    item = tree.build(head=[("resourceType", Val(F.lit(rt), T.StringType()))])
    if live:
        ecols = [F.col(f"_e{i}") for i, _ in live]
        # clean rows (the common case) skip building and compacting the array
        any_err = F.coalesce(*ecols).isNotNull() if len(ecols) > 1 else ecols[0].isNotNull()
        errs = F.when(any_err, F.array_compact(F.array(*ecols))).otherwise(F.array().cast(ERRORS_TYPE))
    else:
        errs = F.array().cast(ERRORS_TYPE)
    sys_col = sys_error if sys_error is not None else F.lit(False)
    corrupt = CORRUPT in cols  # rows the reader could not parse (R6 / X4 route mode)
    carry = cols if keep_original else [c for c in cols if c in keep or c == CORRUPT]
    df3 = df2.select(*[column(c) for c in carry], item.col.alias("_item"), errs.alias("_errors"),
                     sys_col.alias("_sys"))

    # ---- stage 4: mandatory check on clean records, system errors
    clean = F.size("_errors") == 0
    final_errors = F.col("_errors")
    r2_terms: list[Column] = []
    if has_profile and profile.mandatory:
        it = Val(F.col("_item"), item.dtype)
        fired_list: list[tuple[str, Column]] = []
        for el in profile.mandatory:
            rel = el.path[len(rt) + 1:]
            if not rel or el.path == rt:
                continue
            v = get_value(it, rel)
            if v.undefined:
                missing = F.lit(True)
                shown = F.lit('"undefined"')
            else:
                empty_arr = (F.size(v.col) == 0) if isinstance(v.dtype, T.ArrayType) else F.lit(False)
                if isinstance(v.dtype, T.VariantType):
                    empty_arr = F.coalesce(F.to_json(v.col) == "[]", F.lit(False))
                missing = is_missing(v) | empty_arr
                shown = F.when(v.col.isNull(), F.lit('"undefined"')).otherwise(F.lit('"[]"'))
            b = base_path(rel)
            suppress = F.lit(False)
            for prev_rel, prev_fire in fired_list:
                if prev_rel.startswith(b):
                    suppress = suppress | prev_fire
            fire = missing & ~suppress
            fired_list.append((rel, fire))
            msg = f"Mandatory FHIR element '{rel}' (min: {el.min}) is missing, null, or an empty array in the final resource."
            det = _dumps({"rule": f"cardinalityMin: {el.min}"})
            r2_terms.append(F.when(fire, error_struct(POSTCHECK_SOURCE, rel, shown, "Validation", msg, det)))
    if sys_error is not None or r2_terms:
        other = F.array_compact(F.array(*r2_terms)) if r2_terms else F.col("_errors")
        expr = F.when(~clean, F.col("_errors"))
        if sys_error is not None:
            orig_now = original_json(df, variant_col) if keep_original else F.lit(None).cast("string")
            sys_struct = error_struct(None, SYSTEM_TARGET, orig_now, "Transformation", MSG_NO_TYPE, None)
            expr = expr.when(F.col("_sys"), F.array(sys_struct))
        final_errors = expr.otherwise(other)
    df4 = df3.select(*[column(c) for c in carry], F.col("_item"), final_errors.alias("_final_errors"))
    # ---- stage 5: the input record as JSON, built only for error rows
    orig = original_json(df, variant_col) if keep_original else F.lit(None).cast("string")
    errors_out = F.col("_final_errors")
    if corrupt:
        bad = F.col(CORRUPT).isNotNull()
        malformed = error_struct(None, SYSTEM_TARGET, F.to_json(F.array(F.col(CORRUPT))).substr(F.lit(2), F.length(
            F.to_json(F.array(F.col(CORRUPT)))) - 2), "Transformation", MSG_MALFORMED, None)
        errors_out = F.when(bad, F.array(malformed)).otherwise(errors_out)
        orig = F.when(bad, F.col(CORRUPT)).otherwise(orig)
    out = df4.select(
        *[column(c) for c in keep],
        F.when(~F.col(CORRUPT).isNotNull(), F.col("_item")).alias("item") if corrupt else F.col("_item").alias("item"),
        errors_out.alias("errors"),
        F.when(F.size(errors_out) > 0, orig).alias("original"),
    )
    return MapInPlan(out, item.dtype)
