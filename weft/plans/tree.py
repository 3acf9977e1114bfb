"""Target tree: every write of a mapping compiled into one nested Column.

The reference mutates a JS object record by record.  Here every write is
registered once, on the driver, in a static tree whose nodes are objects,
arrays and leaves.  Each write carries a *fire* condition (a boolean Column)
and an ordinal (its position in the mapping fold).  Building the tree gives a
single ``struct``/``array`` expression:

* a leaf is ``coalesce`` over its writes, latest fired write first;
* an object is present iff any write below it fired (``when(any, struct(...))``);
* an index-addressed array keeps slots ``0..k`` where ``k`` is the highest
  slot reached by a fired write; lower slots are padded with ``{}`` (object
  slots) or ``null`` (leaf slots) — P9;
* a predicate-addressed array holds one element per ``[?key='value']`` in
  order of first write, each starting with ``key: value`` — P10;
* a name step on an array writes into every element present at that time,
  creating element 0 when there is none — P11;
* a missing parent becomes an array when the profile says max ``*``/``>1`` or
  when, without a profile entry, its name is one of the usual list elements;
  otherwise an object — P12.

``build(cutoff)`` builds the tree as it was before a given ordinal, which is
how auto-fill sees the record "so far" without any per-row state.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.paths import Bad, Index, Name, Pred, Segment, Val
from weft.plans.config import Element

# Names that become arrays when the profile does not know them.
LIST_NAMES = (
    "coding", "identifier", "extension", "name", "telecom", "contact", "entry", "link", "item", "profile",
)


class CompileError(ValueError):
    pass


@dataclass
class Mark:
    ordinal: int
    cond: Column


def _any(marks: list[Mark], cutoff: int | None) -> Column | None:
    conds = [m.cond for m in marks if cutoff is None or m.ordinal < cutoff]
    if not conds:
        return None
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


@dataclass
class Leaf:
    writes: list[tuple[int, Column, Val]] = field(default_factory=list)
    marks: list[Mark] = field(default_factory=list)


@dataclass
class Obj:
    children: dict[str, Leaf | Obj | Arr] = field(default_factory=dict)
    marks: list[Mark] = field(default_factory=list)


@dataclass
class Arr:
    mode: str | None = None  # "index" | "pred"
    slots: dict[int, Leaf | Obj] = field(default_factory=dict)
    preds: list[tuple[str, str, Obj]] = field(default_factory=list)
    anon: Obj | None = None  # element created by a name step on an empty predicate array
    marks: list[Mark] = field(default_factory=list)
    pad_null: bool = False  # plain nested set leaves holes (JSON null), the FHIR writer pads {}
    log: list = field(default_factory=list)  # every write reaching this array, in order
    path: str = ""  # full path of the array
    choose: object = None  # container choice (P12): (full path, name, next segment) -> array?


@dataclass
class Hybrid:
    """A key written first as a whole value and then below it (e.g. a source array
    mapped to ``telecom``, then ``telecom.system`` auto-filled).  Where the value
    was written, the later writes patch it; where it was not, they build the
    container as usual (``fresh``)."""

    leaf: Leaf
    fresh: Obj | Arr
    patches: list = field(default_factory=list)  # (ordinal, cond, segments, value)
    marks: list[Mark] = field(default_factory=list)
    late: Leaf = field(default_factory=Leaf)  # whole-value writes after the writes below
    path: str = ""
    choose: object = None
    pad_null: bool = False


Node = Leaf | Obj | Arr | Hybrid


# ---------------------------------------------------------------- type unification


def unify(types: list[T.DataType]) -> T.DataType:
    types = [t for t in types if t is not None and not isinstance(t, T.NullType)]
    if not types:
        return T.StringType()
    first = types[0]
    if all(t == first for t in types):
        return first
    if all(isinstance(t, T.StructType) for t in types):
        names: list[str] = []
        per: dict[str, list[T.DataType]] = {}
        for t in types:
            for f in t.fields:
                if f.name not in per:
                    names.append(f.name)
                    per[f.name] = []
                per[f.name].append(f.dataType)
        return T.StructType([T.StructField(n, unify(per[n])) for n in names])
    if all(isinstance(t, T.ArrayType) for t in types):
        return T.ArrayType(unify([t.elementType for t in types]))
    num = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    if all(isinstance(t, num) for t in types):
        if all(isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for t in types):
            return T.LongType()
        return T.DoubleType()
    return T.VariantType()


def conform(col: Column, src: T.DataType, dst: T.DataType) -> Column:
    if src == dst:
        return col
    if isinstance(dst, T.VariantType):
        if isinstance(src, (T.StructType, T.ArrayType, T.MapType)):
            return F.parse_json(F.to_json(col))
        return col.cast(T.VariantType())
    if isinstance(dst, T.StructType) and isinstance(src, T.StructType):
        have = {f.name: f.dataType for f in src.fields}
        parts = []
        for f in dst.fields:
            if f.name in have:
                parts.append(conform(col.getField(f.name), have[f.name], f.dataType).alias(f.name))
            else:
                parts.append(F.lit(None).cast(f.dataType).alias(f.name))
        return F.when(col.isNotNull(), F.struct(*parts))
    if isinstance(dst, T.ArrayType) and isinstance(src, T.ArrayType):
        return F.transform(col, lambda x: conform(x, src.elementType, dst.elementType))
    return col.cast(dst)


def _key_sequence(obj: Obj, head: str | None = None) -> list[str]:
    """Keys of one element in the order its writes create them."""
    keys = sorted(obj.children, key=lambda k: min((m.ordinal for m in obj.children[k].marks), default=1 << 30))
    return ([head] if head else []) + [k for k in keys if k != head]


def _merge_orders(seqs: list[list[str]]) -> list[str]:
    """One key order consistent with every element's own order (topological
    merge; ties go to the key seen first)."""
    first: dict[str, int] = {}
    after: dict[str, set] = {}
    indeg: dict[str, int] = {}
    for seq in seqs:
        for k in seq:
            if k not in first:
                first[k] = len(first)
                after[k] = set()
                indeg[k] = 0
        for x, y in zip(seq, seq[1:]):
            if y not in after[x]:
                after[x].add(y)
                indeg[y] += 1
    out, ready = [], sorted((k for k in first if indeg[k] == 0), key=first.get)
    while ready:
        k = ready.pop(0)
        out.append(k)
        for y in after[k]:
            indeg[y] -= 1
            if indeg[y] == 0:
                ready.append(y)
        ready.sort(key=first.get)
    return out + [k for k in sorted(first, key=first.get) if k not in out]  # cycles: first-seen


def _order_fields(dt: T.DataType, seqs: list[list[str]]) -> T.DataType:
    """Element struct fields in an order matching how each element is written."""
    if not isinstance(dt, T.StructType):
        return dt
    rank = {k: i for i, k in enumerate(_merge_orders(seqs))}
    return T.StructType(sorted(dt.fields, key=lambda f: rank.get(f.name, 1 << 30)))


def _combine(vals: list[Val]) -> list[Val]:
    dt = unify([v.dtype for v in vals])
    return [Val(conform(v.col, v.dtype, dt), dt) for v in vals]


# ---------------------------------------------------------------- the tree


class TargetTree:
    """Collects writes; ``build()`` gives the nested Column."""

    def __init__(self, elements: tuple[Element, ...] = (), resource_type: str = "",
                 heuristics: bool = True) -> None:
        self.root = Obj()
        #: All writes by the record's key they are at or below, and the keys that are built from them.
        self.log: dict[str, list] = {}
        self.replayed: set[str] = set()
        self.by_path = {e.path: e for e in reversed(elements)}  # first element wins
        self.resource_type = resource_type
        self.heuristics = heuristics

    # -- container choice
    def _as_array(self, full_path: str, name: str, next_seg: Segment) -> bool:
        if not self.heuristics:  # plain nested set: an index makes an array
            return isinstance(next_seg, Index)
        el = self.by_path.get(full_path)
        if el is None:
            import re

            stripped = re.sub(r"\[\d+\]", "", full_path)
            if stripped != full_path:
                el = self.by_path.get(stripped)
        if el is not None:
            mx = el.max
            if mx is None or mx == "*":
                return True
            import re

            m = re.match(r"^\s*[+-]?\d+", mx)
            return bool(m) and int(m.group(0)) > 1
        return name in LIST_NAMES

    def _array(self, full: str) -> Arr:
        return Arr(pad_null=not self.heuristics, path=full, choose=self._as_array)

    def set(self, segments: list[Segment], value: Val, cond: Column, ordinal: int) -> None:
        """Register ``setValue(record, path, value)`` firing when ``cond``."""
        if not segments or value.dtype is None:
            return
        if isinstance(segments[0], Pred):
            return  # a filter step on an object: the reference drops the write
        key = self._key(segments[0])
        self.log.setdefault(key, []).append((ordinal, cond, segments[1:], value))
        if key in self.replayed:
            self.root.marks.append(Mark(ordinal, cond))
            return
        try:
            self._set_obj(self.root, segments, value, cond, ordinal, self.resource_type)
        except CompileError:  # writes that no static type can hold: the key's value is built from its log
            self.replayed.add(key)

    @staticmethod
    def _key(seg: Segment) -> str:
        return seg.name if isinstance(seg, Name) else str(seg.index) if isinstance(seg, Index) else seg.text

    def _value(self, key: str, child: Node, cutoff: int | None) -> Val | None:
        if key not in self.replayed:
            try:
                return _build(child, cutoff)
            except CompileError:
                self.replayed.add(key)
        return self._build_log(key, cutoff)

    def _build_log(self, key: str, cutoff: int | None) -> Val | None:
        """General case: all writes at and below a key folded in their order over one VARIANT, a step per write.

        Each step is bound once.  A value written to the key replaces what was there; a write below it goes into the object or array that
        is there, or into the container that P12 chooses.
        """
        entries = [e for e in self.log[key] if cutoff is None or e[0] < cutoff]
        if not entries:
            return None
        full = f"{self.resource_type}.{key}" if self.resource_type else key
        acc = F.lit(None).cast(T.VariantType())
        for _, cond, rest, value in entries:
            def step(x, cond=cond, rest=rest, value=value):
                if not rest:
                    return F.when(cond, _to_variant(value)).otherwise(x)
                made = F.parse_json(F.lit("[]" if self._as_array(full, key, rest[0]) else "{}"))
                base = F.when(_is(x, "OBJECT") | _is(x, "ARRAY"), x).otherwise(made)
                return F.when(cond, _bound(base, lambda y: _vset(y, rest, _to_variant(value), self._as_array, full, not self.heuristics))).otherwise(x)

            acc = _bound(acc, step)
        return Val(acc, T.VariantType())

    def _set_obj(self, node: Obj, segs, value, cond, ordinal, prefix) -> None:
        seg, rest = segs[0], segs[1:]
        if isinstance(seg, Pred):
            return  # a filter step on an object: the reference drops the write
        key = seg.name if isinstance(seg, Name) else str(seg.index) if isinstance(seg, Index) else seg.text
        full = f"{prefix}.{key}" if prefix else key
        node.marks.append(Mark(ordinal, cond))
        child = node.children.get(key)
        if not rest:
            if child is None:
                child = node.children[key] = Leaf()
            if isinstance(child, (Obj, Arr)):  # a whole value written after writes below it
                child = node.children[key] = Hybrid(Leaf(), child, marks=list(child.marks))
            if isinstance(child, Hybrid):
                # it replaces whatever was built before it when it fires
                child.late.writes.append((ordinal, cond, value))
                child.late.marks.append(Mark(ordinal, cond))
                child.marks.append(Mark(ordinal, cond))
                return
            child.writes.append((ordinal, cond, value))
            child.marks.append(Mark(ordinal, cond))
            return
        if isinstance(child, Leaf):  # P8: writes below a value written earlier
            fresh = self._array(full) if self._as_array(full, key, rest[0]) else Obj()
            child = node.children[key] = Hybrid(child, fresh, marks=list(child.marks), path=full, choose=self._as_array, pad_null=not self.heuristics)
        if isinstance(child, Hybrid):
            if child.late.writes:
                raise CompileError(f"path '{full}' is written below a value that replaced earlier writes")
            child.patches.append((ordinal, cond, rest, value))
            child.marks.append(Mark(ordinal, cond))
            target = child.fresh
            if isinstance(target, Obj):
                self._set_obj(target, rest, value, cond, ordinal, full)
            else:
                self._set_arr(target, rest, value, cond, ordinal, full)
            return
        if child is None:
            child = self._array(full) if self._as_array(full, key, rest[0]) else Obj()
            node.children[key] = child
        if isinstance(child, Obj):
            self._set_obj(child, rest, value, cond, ordinal, full)
        else:
            self._set_arr(child, rest, value, cond, ordinal, full)

    def _set_arr(self, node: Arr, segs, value, cond, ordinal, prefix) -> None:
        seg, rest = segs[0], segs[1:]
        if isinstance(seg, Bad):
            return
        node.log.append((ordinal, cond, seg, rest, value))
        if node.mode == "replay":
            node.marks.append(Mark(ordinal, cond))
            return
        runtime_order = (
            node.mode == "seq"
            # an index after a filter write may land on a filter-created element
            or (isinstance(seg, Index) and node.mode in ("pred", "mixed"))
            # a name step over index slots and filter elements together
            or (isinstance(seg, Name) and node.mode == "mixed")
        )
        if runtime_order:
            # H3 general case: the array is rebuilt from the write log, one array
            # step per write, in write order (see _build_seq)
            node.mode = "seq"
            node.marks.append(Mark(ordinal, cond))
            return
        if isinstance(seg, Index):
            node.mode = "index"
            node.marks.append(Mark(ordinal, cond))
            slot = node.slots.get(seg.index)
            want_leaf = not rest
            if slot is None:
                slot = node.slots[seg.index] = Leaf() if want_leaf else Obj()
            if isinstance(slot, Leaf) != want_leaf or any(
                isinstance(s, Leaf) != want_leaf for s in node.slots.values()
            ):
                node.mode = "replay"  # values and objects in one array
                return
            if want_leaf:
                slot.writes.append((ordinal, cond, value))
                slot.marks.append(Mark(ordinal, cond))
            else:
                slot.marks.append(Mark(ordinal, cond))
                self._set_obj(slot, rest, value, cond, ordinal, f"{prefix}[{seg.index}]")
            return
        if isinstance(seg, Pred):
            if node.mode == "index":
                # H3, decidable case: every index write came first and no index
                # slot carries the filter key, so the filter can only match
                # elements it created itself, appended after the index slots
                if any(isinstance(sl, Leaf) or seg.key in sl.children for sl in node.slots.values()):
                    node.mode = "replay"  # the filter may match an index slot, by row
                    node.marks.append(Mark(ordinal, cond))
                    return
                node.mode = "mixed"
            elif node.mode is None:
                node.mode = "pred"
            node.marks.append(Mark(ordinal, cond))
            for k, v, obj in node.preds:
                if k == seg.key and v == seg.value:
                    break
            else:
                obj = Obj()
                node.preds.append((seg.key, seg.value, obj))
            obj.marks.append(Mark(ordinal, cond))
            if rest:
                self._set_obj(obj, rest, value, cond, ordinal, f"{prefix}[?{seg.key}='{seg.value}']")
            return
        # name step on an array: every present element, or a new element 0
        node.marks.append(Mark(ordinal, cond))
        if node.mode == "pred" or (node.mode is None and node.preds):
            present = [(obj, _any(obj.marks, None)) for _, _, obj in node.preds]
            any_before = _any([m for _, _, o in node.preds for m in o.marks], None)
            for obj, ex in present:
                if ex is not None:
                    c = cond & ex
                    obj.marks.append(Mark(ordinal, c))
                    self._set_obj(obj, segs, value, c, ordinal, prefix)
            if node.anon is None:
                node.anon = Obj()
            anon_before = _any(node.anon.marks, None)
            c = cond if any_before is None else cond & ~any_before
            if anon_before is not None:
                c = c | (cond & anon_before)
            node.anon.marks.append(Mark(ordinal, c))
            self._set_obj(node.anon, segs, value, c, ordinal, prefix)
            return
        if any(isinstance(s, Leaf) for s in node.slots.values()):
            node.mode = "replay"
            return
        node.mode = "index"
        top = max(node.slots) if node.slots else 0
        for i in range(0, top + 1):
            if i == 0:
                c = cond
            else:
                later = [m for j, s in node.slots.items() if j >= i for m in s.marks]
                ex = _any(later, None)
                if ex is None:
                    continue
                c = cond & ex
            slot = node.slots.get(i)
            if slot is None:
                slot = node.slots[i] = Obj()
            slot.marks.append(Mark(ordinal, c))
            self._set_obj(slot, segs, value, c, ordinal, f"{prefix}[{i}]")

    # ------------------------------------------------------------ building

    def build(self, cutoff: int | None = None, head: list[tuple[str, Val]] = ()) -> Val:
        """The record as a struct Val; ``head`` fields come first (e.g. resourceType)."""
        parts = list(head)
        heads = [k for k, _ in head]
        for k in self.log:
            child = self.root.children.get(k)
            if child is None and k not in self.replayed:
                continue
            v = self._value(k, child, cutoff)
            if v is None:
                continue
            if k in heads:  # a write to a head field replaces it where it fires
                at = heads.index(k)
                own, given = _combine([v, parts[at][1]])
                parts[at] = (k, Val(F.coalesce(own.col, given.col), own.dtype))
            else:
                parts.append((k, v))
        if not parts:
            return Val(F.struct(F.lit(None).cast("string").alias("_empty")), T.StructType([T.StructField("_empty", T.StringType())]))
        st = T.StructType([T.StructField(k, v.dtype) for k, v in parts])
        return Val(F.struct(*[v.col.alias(k) for k, v in parts]), st)

    def present(self, cutoff: int | None = None) -> Column | None:
        """Condition that anything at all was written (before ``cutoff``)."""
        return _any(self.root.marks, cutoff)


def _chain(segs, value: Val, cond: Column) -> Val:
    """A new nested struct holding ``value`` at the name path ``segs``."""
    seg = segs[0]
    if not isinstance(seg, (Name, Index)):
        raise CompileError("only name steps may follow a value written as a whole")
    name = seg.name if isinstance(seg, Name) else str(seg.index)
    inner = Val(F.when(cond, value.col), value.dtype) if len(segs) == 1 else _chain(segs[1:], value, cond)
    return Val(F.when(cond, F.struct(inner.col.alias(name))), T.StructType([T.StructField(name, inner.dtype)]))


def _to_variant(v: Val) -> Column:
    if isinstance(v.dtype, T.VariantType):
        return v.col
    if isinstance(v.dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.parse_json(F.to_json(v.col))
    return v.col.cast(T.VariantType())


def _bound(x: Column, use) -> Column:
    """``use(x)`` with ``x`` evaluated once."""
    return F.get(F.transform(F.array(x), lambda y: use(y)), 0)


def _is(x: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(x).startswith(kind), F.lit(False))


def _vset(x: Column, segs, value: Column, choose, full: str, pad_null: bool) -> Column:
    """``setValue`` per row on a VARIANT container ``x``, for any steps: an index
    pads and writes its slot, a filter finds or appends its element, a name
    writes into an object or into every object of an array (a new one when
    it is empty); missing and scalar parents become the container of P12."""
    seg, rest = segs[0], segs[1:]
    new_object, null = F.parse_json(F.lit("{}")), F.parse_json(F.lit("null"))

    def into_object(o: Column) -> Column:
        if isinstance(seg, Pred):
            return o
        key = seg.name if isinstance(seg, Name) else str(seg.index) if isinstance(seg, Index) else seg.text
        below = f"{full}.{key}" if full else key
        fields = F.try_variant_get(o, "$", "map<string,variant>")
        if not rest:
            child = value
        else:
            made = F.parse_json(F.lit("[]" if choose(below, key, rest[0]) else "{}"))
            now = F.try_element_at(fields, F.lit(key))
            child = _bound(F.when(_is(now, "OBJECT") | _is(now, "ARRAY"), now).otherwise(made), lambda c: _vset(c, rest, value, choose, below, pad_null))
        return F.to_variant_object(F.map_concat(F.map_filter(fields, lambda k, _: k != key), F.create_map(F.lit(key), child)))

    def below_element(e: Column, place: str) -> Column:
        return _bound(F.when(_is(e, "OBJECT"), e).otherwise(new_object), lambda o: _vset(o, rest, value, choose, place, pad_null))

    def into_array(a: Column) -> Column:
        if isinstance(seg, Index):
            i = seg.index
            filler = new_object if rest and not pad_null else null
            padded = F.concat(a, F.array_repeat(filler, F.greatest(F.lit(i + 1) - F.size(a), F.lit(0))))
            return F.transform(padded, lambda e, j: F.when(j == i, below_element(e, f"{full}[{i}]") if rest else value).otherwise(e))
        if isinstance(seg, Pred):
            place = f"{full}[?{seg.key}='{seg.value}']"
            held = lambda e: F.try_element_at(F.try_variant_get(e, "$", "map<string,variant>"), F.lit(seg.key))
            # a number isn't the text that spells it
            same = lambda e: F.coalesce(_is(e, "OBJECT") & (F.schema_of_variant(held(e)) == "STRING") & (held(e).cast("string") == seg.value), F.lit(False))
            made = F.to_variant_object(F.create_map(F.lit(seg.key), F.lit(seg.value).cast(T.VariantType())))
            hit = F.array_position(F.transform(a, same), True)
            into = (lambda e: below_element(e, place)) if rest else (lambda e: e)
            return F.when(hit > 0, F.transform(a, lambda e, j: F.when(j == hit - 1, into(e)).otherwise(e))).otherwise(F.concat(a, F.array(into(made))))
        if isinstance(seg, Name):
            some = F.when(F.size(a) == 0, F.array(new_object)).otherwise(a)
            return F.transform(some, lambda e: F.when(_is(e, "OBJECT"), into_object(e)).otherwise(e))
        return a

    listed = F.try_variant_get(x, "$", "array<variant>")
    return F.when(_is(x, "ARRAY"), F.to_variant_object(_bound(listed, into_array))).otherwise(into_object(x))


def _build_replay(node: Arr, cutoff) -> Val | None:
    """An array whose writes don't fit one element type, or meet each other by row:
    its write log applied in order to a VARIANT array."""
    entries = [e for e in node.log if cutoff is None or e[0] < cutoff]
    if not entries:
        return None
    acc, fired = F.parse_json(F.lit("[]")), None
    for _, c, seg, rest, value in entries:
        def step(a, c=c, segs=[seg, *rest], value=value):
            return F.when(c, _vset(a, segs, _to_variant(value), node.choose, node.path, node.pad_null)).otherwise(a)

        acc = _bound(acc, step)
        fired = c if fired is None else fired | c
    return Val(F.when(fired, acc), T.VariantType())


def _plain_names(segs, choose, full: str) -> bool:
    """Whether all steps are names and every container between them an object."""
    for i, seg in enumerate(segs):
        if not isinstance(seg, Name):
            return False
        full = f"{full}.{seg.name}"
        if i + 1 < len(segs) and choose(full, seg.name, segs[i + 1]):
            return False
    return True


def _patch(v: Val, segs, value: Val, cond: Column) -> Val:
    """``setValue`` applied to an existing value column (P8 below a value, P11 over
    an array of row-dependent length)."""
    dt = v.dtype
    seg, rest = segs[0], segs[1:]
    if isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.StructType) and isinstance(seg, Name):
        et = dt.elementType
        probe = _patch(Val(F.lit(None).cast(et), et), segs, value, cond)  # element type after the write
        new_et = probe.dtype
        empty_case = conform(_chain(segs, value, F.lit(True)).col, _chain(segs, value, F.lit(True)).dtype, new_et)
        each = F.transform(v.col, lambda x: conform(_patch(Val(x, et), segs, value, cond).col, probe.dtype, new_et))
        col = F.when(cond & (F.size(v.col) == 0), F.array(empty_case)).otherwise(each)
        return Val(col, T.ArrayType(new_et))
    if isinstance(dt, T.StructType) and isinstance(seg, (Name, Index)):
        name = seg.name if isinstance(seg, Name) else str(seg.index)
        names = dt.fieldNames()
        if name in names:
            cur = Val(v.col.getField(name), dt[name].dataType)
            if not rest:
                a, b = _combine([cur, value])
                new = Val(F.when(cond, b.col).otherwise(a.col), a.dtype)
            else:
                new = _patch(cur, rest, value, cond)
        else:
            new = Val(F.when(cond, value.col), value.dtype) if not rest else _chain(rest, value, cond)
        fields = [T.StructField(f.name, new.dtype if f.name == name else f.dataType) for f in dt.fields]
        if name not in names:
            fields.append(T.StructField(name, new.dtype))
        fresh = _chain(segs, value, cond)  # a null struct value gets a new object
        st = T.StructType(fields)
        patched = v.col.withField(name, new.col)
        return Val(F.when(v.col.isNull(), conform(fresh.col, fresh.dtype, st)).otherwise(patched), st)
    raise CompileError("a value written as a whole can only be extended when it is an object or array of objects")


def _build(node: Node, cutoff: int | None, always: bool = False) -> Val | None:
    if isinstance(node, Hybrid):
        base = _build_hybrid(node, cutoff)
        late = _build(node.late, cutoff)
        if late is None:
            return base
        if base is None:
            return late
        fired = _any(node.late.marks, cutoff)
        a, b = _combine([late, base])
        return Val(F.when(F.coalesce(fired, F.lit(False)), a.col).otherwise(b.col), a.dtype)
    return _build_plain(node, cutoff, always)


def _build_hybrid(node: Hybrid, cutoff: int | None) -> Val | None:
    leaf = _build(node.leaf, cutoff)
    fresh = _build(node.fresh, cutoff)
    if leaf is None:
        return fresh
    active = [(o, c, segs, value) for o, c, segs, value in node.patches if cutoff is None or o < cutoff]
    if not isinstance(leaf.dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        # A scalar is replaced by a new container at the first write below
        # it, which the later writes fill — exactly the fresh container
        if fresh is None or not active:
            return leaf
        fired = active[0][1]
        for _, c, _, _ in active[1:]:
            fired = fired | c
        a, b = _combine([leaf, fresh])
        return Val(F.when(F.coalesce(fired, F.lit(False)), b.col).otherwise(a.col), a.dtype)
    struct_like = isinstance(leaf.dtype, (T.StructType, T.ArrayType))
    if struct_like and all(_plain_names(segs, node.choose, node.path) for _, _, segs, _ in active):
        patched = leaf
        for _, c, segs, value in active:
            patched = _patch(patched, segs, value, c)
    else:  # indexes, filters or lists below the value: write into it per row
        name = node.path.rsplit(".", 1)[-1]
        col = _to_variant(leaf)
        for _, c, segs, value in active:
            made = F.parse_json(F.lit("[]" if node.choose(node.path, name, segs[0]) else "{}"))

            def step(x, c=c, segs=segs, value=value, made=made):
                base = F.when(_is(x, "OBJECT") | _is(x, "ARRAY"), x).otherwise(made)
                return F.when(c, _bound(base, lambda y: _vset(y, segs, _to_variant(value), node.choose, node.path, node.pad_null))).otherwise(x)

            col = _bound(col, step)
        patched = Val(col, T.VariantType())
    if fresh is None:
        return patched
    dt = unify([patched.dtype, fresh.dtype])
    col = F.when(leaf.col.isNotNull(), conform(patched.col, patched.dtype, dt)).otherwise(
        conform(fresh.col, fresh.dtype, dt))
    return Val(col, dt)


def _build_plain(node: Node, cutoff: int | None, always: bool = False) -> Val | None:
    if isinstance(node, Leaf):
        ws = [(o, c, v) for o, c, v in node.writes if cutoff is None or o < cutoff]
        if not ws:
            return None
        vals = _combine([v for _, _, v in ws])
        col = None
        for (_, c, _), v in reversed(list(zip(ws, vals))):
            term = F.when(c, v.col)
            col = term if col is None else F.coalesce(col, term)
        return Val(col, vals[0].dtype)
    if isinstance(node, Obj):
        return _build_obj(node, cutoff, always)
    return _build_arr(node, cutoff)


def _build_obj(node: Obj, cutoff, always: bool, head: list[tuple[str, Val]] = ()) -> Val | None:
    present = _any(node.marks, cutoff)
    if present is None and not always:
        return None
    parts = list(head)
    for k, child in node.children.items():
        if any(k == h for h, _ in head):
            continue
        v = _build(child, cutoff)
        if v is not None:
            parts.append((k, v))
    if not parts:
        if not always and present is None:
            return None
        parts = [("_empty", Val(F.lit(None).cast("string"), T.StringType()))]
    st = T.StructType([T.StructField(k, v.dtype) for k, v in parts])
    col = F.struct(*[v.col.alias(k) for k, v in parts])
    if not always:
        col = F.when(present, col)
    return Val(col, st)


def _index_part(node: Arr, cutoff):
    """Index slots: (element Vals or None for padding, length Column, leaf slots?)."""
    top = max(node.slots)
    leafy = any(isinstance(s, Leaf) for s in node.slots.values())
    elems: list[Val | None] = []
    for i in range(top + 1):
        slot = node.slots.get(i)
        if slot is None:
            elems.append(None)
        elif isinstance(slot, Leaf):
            elems.append(_build(slot, cutoff))
        else:
            elems.append(_build_obj(slot, cutoff, always=True))
    # length = highest slot reached + 1 (lower slots are padding); the
    # outermost test is the highest slot
    count = F.lit(0)
    for i in range(0, top + 1):
        own = _any(node.slots[i].marks, cutoff) if i in node.slots else None
        if own is not None:
            count = F.when(own, F.lit(i + 1)).otherwise(count)
    return elems, count, leafy


def _pred_part(node: Arr, cutoff) -> list[Val]:
    """Filter-created elements in order of first write (NULL when not created)."""
    elems = []
    if node.anon is not None:
        a = _build_obj(node.anon, cutoff, always=False)
        if a is not None:
            elems.append(a)
    for k, v, obj in node.preds:
        key_val = Val(F.lit(v), T.StringType())
        if k in obj.children:
            kv = _build(obj.children[k], cutoff)
            if kv is not None:
                key_val = Val(F.coalesce(kv.col.cast("string"), F.lit(v)), T.StringType())
        e = _build_obj(obj, cutoff, always=False, head=[(k, key_val)])
        if e is not None:
            elems.append(e)
    return elems


def _padding(et: T.DataType, leafy: bool, pad_null: bool) -> Column:
    if isinstance(et, T.StructType) and not leafy and not pad_null:
        return F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in et.fields])
    return F.lit(None).cast(et)


def _name_chain_type(segs, value_type: T.DataType) -> T.DataType:
    seg = segs[0]
    if not isinstance(seg, (Name, Index)):
        raise CompileError("only name steps may follow an array step that depends on earlier writes")
    name = seg.name if isinstance(seg, Name) else str(seg.index)
    inner = value_type if len(segs) == 1 else _name_chain_type(segs[1:], value_type)
    return T.StructType([T.StructField(name, inner)])


def _empty(st: T.StructType) -> Column:
    return F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in st.fields])


def _set_in(x: Column, st: T.StructType, segs, value: Val) -> Column:
    """setValue on one struct element whose type already holds every field written."""
    seg = segs[0]
    name = seg.name if isinstance(seg, Name) else str(seg.index)
    ft = st[name].dataType
    if len(segs) == 1:
        return x.withField(name, conform(value.col, value.dtype, ft))
    if not isinstance(ft, T.StructType):
        raise CompileError("only name steps may follow an array step that depends on earlier writes")
    return x.withField(name, _set_in(F.coalesce(x.getField(name), _empty(ft)), ft, segs[1:], value))


def _guarded(cond: Column, step):
    """One array step applied only where its write fired (a one-argument lambda)."""
    return lambda a: F.when(cond, step(a)).otherwise(a)


def _build_seq(node: Arr, cutoff) -> Val | None:
    """H3 general case: replay the array's writes in order as array steps — an
    index pads with {} then writes that slot, a filter finds the first element
    whose key equals the text or appends a new one, a name step writes into
    every element (or a new one when empty).  Each step is bound once
    (``transform(array(a), ...)[0]``) so the expression stays linear."""
    entries = [e for e in node.log if cutoff is None or e[0] < cutoff]
    if not entries:
        return None
    # values as elements, and lists below an element, need the general form
    steps = [([seg, *rest] if isinstance(seg, Name) else list(rest), seg) for _, _, seg, rest, _ in entries]
    if any(not segs and not isinstance(seg, Pred) for segs, seg in steps) or any(not _plain_names(segs, node.choose, node.path) for segs, _ in steps):
        return _build_replay(node, cutoff)
    types, seqs = [], []
    for _, _, seg, rest, value in entries:
        segs = [seg] + list(rest) if isinstance(seg, Name) else list(rest)
        t = _name_chain_type(segs, value.dtype) if segs else None
        if t is None and not isinstance(seg, Pred):
            raise CompileError("values (not objects) in an array written out of order are not supported")
        names = [t.fields[0].name] if t is not None else []
        if isinstance(seg, Pred):
            kt = T.StructType([T.StructField(seg.key, T.StringType())])
            t = kt if t is None else unify([kt, t])
            names = [seg.key] + names
        types.append(t)
        seqs.append(names)
    et = _order_fields(unify(types), seqs)
    empty = _empty(et)
    acc = F.array().cast(T.ArrayType(et))
    for _, c, seg, rest, value in entries:
        def step(a, seg=seg, rest=rest, value=value):
            if isinstance(seg, Index):
                i = seg.index
                padded = F.concat(a, F.array_repeat(empty, F.greatest(F.lit(i + 1) - F.size(a), F.lit(0))))
                return F.transform(padded, lambda x, j: F.when(j == i, _set_in(x, et, rest, value) if rest
                                                                else x).otherwise(x))
            if isinstance(seg, Pred):
                hit = F.array_position(F.transform(a, lambda x: F.coalesce(x.getField(seg.key) == seg.value,
                                                                             F.lit(False))), True)
                new = empty.withField(seg.key, F.lit(seg.value))
                new = _set_in(new, et, rest, value) if rest else new
                upd = F.transform(a, lambda x, j: F.when(j == hit - 1, _set_in(x, et, rest, value) if rest
                                                         else x).otherwise(x))
                return F.when(hit > 0, upd).otherwise(F.concat(a, F.array(new)))
            segs = [seg] + list(rest)
            return F.when(F.size(a) == 0, F.array(_set_in(empty, et, segs, value))).otherwise(
                F.transform(a, lambda x: _set_in(x, et, segs, value)))

        acc = F.get(F.transform(F.array(acc), _guarded(c, step)), 0)
    present = _any(node.marks, cutoff)
    return Val(F.when(present, acc), T.ArrayType(et))


def _build_arr(node: Arr, cutoff) -> Val | None:
    present = _any(node.marks, cutoff)
    if present is None:
        return None
    if node.mode == "seq":
        return _build_seq(node, cutoff)
    if node.mode == "replay":
        return _build_replay(node, cutoff)
    idx = _index_part(node, cutoff) if node.slots else None
    preds = _pred_part(node, cutoff) if (node.preds or node.anon is not None) else []
    typed = [e for e in (idx[0] if idx else []) if e is not None and e.dtype is not None] + preds
    if not typed:
        return None
    et = unify([e.dtype for e in typed])
    seqs = [_key_sequence(node.slots[i]) for i in sorted(node.slots) if isinstance(node.slots[i], Obj)]
    if node.anon is not None:
        seqs.append(_key_sequence(node.anon))
    seqs += [_key_sequence(obj, k) for k, _, obj in node.preds]
    et = _order_fields(et, seqs)
    # presence is known from the write conditions (OR of cheap tests), so the
    # array expression itself is evaluated once, never re-tested for emptiness
    parts = []
    if idx is not None:
        elems, count, leafy = idx
        cols = [_padding(et, leafy, node.pad_null) if e is None or e.dtype is None else conform(e.col, e.dtype, et)
                for e in elems]
        idx_present = _any([m for sl in node.slots.values() for m in sl.marks], cutoff)
        sliced = F.slice(F.array(*cols), 1, count)
        parts.append((idx_present, sliced))
    if preds:
        pcols = [conform(e.col, e.dtype, et) for e in preds]
        pred_objs = ([node.anon] if node.anon is not None else []) + [o for _, _, o in node.preds]
        pred_present = _any([m for o in pred_objs for m in o.marks], cutoff)
        parts.append((pred_present, F.array_compact(F.array(*pcols))))
    parts = [(c, a) for c, a in parts if c is not None]
    if not parts:
        return None
    if len(parts) == 1:
        cond, arr = parts[0]
    else:
        empty = F.array().cast(T.ArrayType(et))
        cond = parts[0][0] | parts[1][0]
        arr = F.concat(*[F.when(c, a).otherwise(empty) for c, a in parts])
    return Val(F.when(cond, arr), T.ArrayType(et))
