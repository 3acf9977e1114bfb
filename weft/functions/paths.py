"""Path grammar and path reads.

A path such as ``extension[?url='x'].coding[0].code`` is split once on the
driver into segments; the read itself is a native Column expression.

Segment kinds:
  ``Name("code")``        property step
  ``Index(0)``            ``[0]``
  ``Pred("url", "x")``    ``[?url='x']`` (first array element whose key equals the text)
  ``Bad("[...]")``        any other bracket text; reads give undefined

Values travel as :class:`Val` — a Column plus its static Spark type.  A
``dtype`` of ``None`` means "statically undefined" (the path cannot exist in
the input schema), which lets the compiler drop dead branches instead of
emitting null columns everywhere.  ``VariantType`` marks dynamic input (JSON /
typed CSV cells); every other type is resolved against the schema at compile
time, so a typed read is plain ``getField``/``get`` and keeps nested-column
pruning at the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: predicate form accepted inside brackets.
_PRED_RE = re.compile(r"^\[\?([a-zA-Z0-9_:]+)='([^']*)'\]$")


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Index:
    index: int


@dataclass(frozen=True)
class Pred:
    key: str
    value: str


@dataclass(frozen=True)
class Bad:
    text: str


Segment = Name | Index | Pred | Bad


# A step is a bracket group (text in single quotes may hold any bracket or dot;
# without a closing quote or bracket it reaches as far as it can) or a run of
# name characters; dots only part steps.
_STEP_RE = re.compile(r"\[(?:'[^']*'|[^'\]])*\]|\[[^\]]*\]?|[^.\[]+")
_NUMBER_RE = re.compile(r"\[([0-9]+)\]")


def split_path(path: str | None) -> list[str]:
    """The steps of a path as texts; an index group ``[n]`` gives ``n``."""
    steps = _STEP_RE.findall(path or "")
    return [_NUMBER_RE.sub(r"\1", s) if _NUMBER_RE.fullmatch(s) else s for s in steps]


def parse_path(path: str | None) -> list[Segment]:
    """Typed segments of a path (see module doc)."""
    segs: list[Segment] = []
    for raw in split_path(path):
        if raw.isdigit() and raw.isascii():
            segs.append(Index(int(raw)))
        elif raw.startswith("[?") and raw.endswith("]"):
            m = _PRED_RE.match(raw)
            segs.append(Pred(m.group(1), m.group(2)) if m else Bad(raw))
        elif raw.startswith("[") and raw.endswith("]"):
            segs.append(Bad(raw))
        else:
            segs.append(Name(raw))
    return segs


def column(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def base_path(path: str) -> str:
    """Text before the first ``[``."""
    return path.split("[")[0]


@dataclass(frozen=True)
class Val:
    """A value Column with its static type; ``dtype is None`` = undefined."""

    col: Column
    dtype: T.DataType | None
    kind: Column | None = None  # bound schema_of_variant(col), when the compiler has one
    text: Column | None = None  # bound String(v) of a VARIANT value, when the compiler has one

    @property
    def undefined(self) -> bool:
        return self.dtype is None

    @property
    def is_variant(self) -> bool:
        return isinstance(self.dtype, T.VariantType)


def variant_kind(v: Val) -> Column:
    """``schema_of_variant`` of a VARIANT value, reusing a bound column if present."""
    return v.kind if v.kind is not None else F.schema_of_variant(v.col)


def undefined() -> Val:
    return Val(F.lit(None), None)


def variant_nullif(c: Column) -> Column:
    """JSON null read out of a VARIANT becomes SQL NULL (null == missing)."""
    return F.when(~F.is_variant_null(c), c)


def _vget(c: Column, jsonpath: str) -> Column:
    return F.try_variant_get(c, jsonpath, "variant")


def variant_at(c: Column, keys: tuple[str, ...]) -> Column:
    """The value below an object's keys, each taken as it stands: no index, no filter, no first element of an array."""
    return reduce(_key_of, keys, c)


def _key_of(c: Column, key: str) -> Column:
    if re.fullmatch(r"[^\s.\[][^.\[]*", key):
        return _vget(c, f"$.{key}")
    for quote in "'\"":
        if re.fullmatch(rf"[^\s{quote}?][^{quote}?]*", key):
            return _vget(c, f"$[{quote}{key}{quote}]")
    # no path of Spark's can spell it
    return F.try_element_at(F.try_variant_get(c, "$", "map<string,variant>"), F.lit(key))


def _quote_key(name: str) -> str:
    return '$["' + name.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def _bind(c: Column, fn) -> Column:
    """Evaluate ``fn`` on ``c`` once even though ``fn`` uses its argument
    twice: ``transform(array(c), x -> fn(x))[0]``.  Keeps deep variant paths
    linear in size instead of doubling per step."""
    return F.get(F.transform(F.array(c), fn), 0)


def _variant_step(c: Column, seg: Segment, simple_input: bool) -> Column:
    if isinstance(seg, Index):
        return variant_nullif(_vget(c, f"$[{seg.index}]"))
    if isinstance(seg, Name):
        key = _quote_key(seg.name)

        def name_step(x: Column) -> Column:
            # object → property; array → property of element 0 (only an object has one)
            return variant_nullif(F.coalesce(_vget(x, key), _vget(x, "$[0]" + key[1:])))

        return name_step(c) if simple_input else _bind(c, name_step)
    if isinstance(seg, Pred):
        key = _quote_key(seg.key)

        def pred_step(x: Column) -> Column:
            arr = F.try_variant_get(x, "$", "array<variant>")
            hit = F.filter(
                arr,
                lambda e: F.coalesce(
                    (F.schema_of_variant(_vget(e, key)) == F.lit("STRING"))
                    & (F.try_variant_get(e, key, "string") == F.lit(seg.value)),
                    F.lit(False),
                ),
            )
            return variant_nullif(F.try_element_at(hit, F.lit(1)))

        return pred_step(c) if simple_input else _bind(c, pred_step)
    return F.lit(None).cast(T.VariantType())


def get_path(root: Val, segments: list[Segment]) -> Val:
    """Read a path with the reference's rules (P2-P6); missing → undefined."""
    cur = root
    simple = True
    for seg in segments:
        if cur.undefined:
            return undefined()
        dt = cur.dtype
        if isinstance(dt, T.VariantType):
            cur = Val(_variant_step(cur.col, seg, simple), dt)
            simple = False
            continue
        simple = False
        if isinstance(seg, Bad):
            return undefined()
        if isinstance(dt, T.StructType):
            key = str(seg.index) if isinstance(seg, Index) else seg.name if isinstance(seg, Name) else None
            if key is None or key not in dt.fieldNames():
                return undefined()
            cur = Val(cur.col.getField(key), dt[key].dataType)
        elif isinstance(dt, T.MapType):
            if isinstance(seg, Pred):
                return undefined()
            key = str(seg.index) if isinstance(seg, Index) else seg.name
            cur = Val(F.try_element_at(cur.col, F.lit(key)), dt.valueType)
        elif isinstance(dt, T.ArrayType):
            et = dt.elementType
            if isinstance(seg, Index):
                cur = Val(F.get(cur.col, seg.index), et)
            elif isinstance(seg, Pred):
                if not isinstance(et, T.StructType) or seg.key not in et.fieldNames():
                    return undefined()
                if isinstance(et[seg.key].dataType, T.VariantType):
                    match = lambda e: F.coalesce(
                        (F.schema_of_variant(e.getField(seg.key)) == F.lit("STRING"))
                        & (F.try_variant_get(e.getField(seg.key), "$", "string") == F.lit(seg.value)),
                        F.lit(False),
                    )
                elif isinstance(et[seg.key].dataType, T.StringType):
                    match = lambda e: F.coalesce(e.getField(seg.key) == F.lit(seg.value), F.lit(False))
                else:
                    return undefined()
                cur = Val(F.try_element_at(F.filter(cur.col, match), F.lit(1)), et)
            else:  # name step on an array: property of element 0 when it is an object
                first = Val(F.get(cur.col, 0), et)
                if isinstance(et, (T.StructType, T.MapType, T.VariantType)):
                    cur = get_path(first, [seg])
                else:
                    return undefined()
        else:
            return undefined()
    return cur


def get_value(root: Val, path: str) -> Val:
    return get_path(root, parse_path(path))
