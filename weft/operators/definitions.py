"""Profile ingest and lookup.

Profile documents (StructureDefinitions, bare or as the first entry of a
Bundle) arrive as a VARIANT column, one document per row, from files or any
table.  Ingest is a distributed job:

* unwrap + checks → ``definitions`` rows or ``rejects`` rows with a reason;
* ``posexplode`` of ``snapshot.element`` (else ``differential.element``) →
  ``definition_elements`` rows, fixed/default values extracted per element;
* keep-first dedupe on (definition, path) with a window (W2).

Storing appends a new version of each definition (K6): elements first, then
headers, so a reader that goes through the latest header (W1) never sees a
half-written version.  No MERGE or delete is needed.
"""

from __future__ import annotations

from dataclasses import dataclass
import hashlib
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.coerce import js_string
from weft.functions.paths import Val
from weft.plans.config import latest_definitions
from weft.session import materialize

import pyspark.sql.types as T


def _vs(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _vv(v: Column, path: str) -> Column:
    x = F.try_variant_get(v, path, "variant")
    return F.when(~F.is_variant_null(x), x)


@dataclass
class Ingested:
    definitions: DataFrame  # one row per accepted document
    elements: DataFrame  # after keep-first dedupe
    rejects: DataFrame  # doc_pos, reason
    counts: DataFrame  # url, elementCount (before dedupe, A2)


def _stored_text(value: Column) -> Column:
    """C4: object/array values as JSON text, JSON null as 'null', scalars as String()."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY") | (kind == "VOID"), F.to_json(value))
        .otherwise(js_string(Val(value, T.VariantType())))
    )


#: Header columns and the fields of a profile that they hold.
_HEADER = {"version": "version", "name": "name", "type": "type", "fhirVersion": "fhirVersion", "description": "description", "resourceId": "id"}


def _first_key(keys: Column, prefix: str) -> Column:
    hit = F.array_sort(F.filter(keys, lambda k: k.startswith(prefix)))
    return F.try_element_at(hit, F.lit(1))


def _elements(sd: Column) -> Column:
    """snapshot.element, or else differential.element, as an array."""
    found = F.coalesce(_vv(sd, "$.snapshot.element"), _vv(sd, "$.differential.element"))
    return F.try_variant_get(found, "$", "array<variant>")


def _has_elements(sd: Column) -> Column:
    """Whether that array has an element."""
    pick = lambda part: F.when(_vv(sd, f"$.{part}.element").isNotNull(), F.try_variant_get(sd, f"$.{part}.element[0]", "variant").isNotNull())
    return F.coalesce(pick("snapshot"), pick("differential"), F.lit(False))


def ingest(docs: DataFrame, doc_col: str = "doc", processed_at: Column | None = None) -> Ingested:
    """Profile documents → definition rows, element rows, rejects."""
    # one literal per ingest: current_timestamp() would differ between the two writes
    now = processed_at if processed_at is not None else F.lit(
        datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp")
    # a document's parts are read once: the profile, then its header fields.  Headers
    # go through the per-url shuffle without the document; the element array
    # is not carried through it but re-read from the chosen document
    d = F.col(doc_col)
    rtype = _vs(d, "$.resourceType")
    in_bundle = (rtype == "Bundle") & F.coalesce(_vs(d, "$.entry[0].resource.resourceType") == "StructureDefinition", F.lit(False))
    sd = F.when(in_bundle, _vv(d, "$.entry[0].resource")).when(rtype == "StructureDefinition", d)
    step = docs.select(d.alias("_doc"), rtype.alias("_rtype"), sd.alias("sd"))
    s = F.col("sd")
    step = step.select("*", _vs(s, "$.url").alias("url"), _has_elements(s).alias("_any"))
    url = F.col("url")
    reason = (
        F.when(s.isNull() & F.coalesce(F.col("_rtype") == "Bundle", F.lit(False)),
               F.lit("Bundle received, but no StructureDefinition found in the first entry."))
        .when(s.isNull(), F.concat(F.lit("Unexpected document: "), F.to_json(F.col("_doc"))))
        .when(url.isNull() | (url == ""), F.lit("Document is not a valid StructureDefinition (missing URL)."))
        .when(~F.col("_any"), F.concat(F.lit("StructureDefinition "), url, F.lit(" has no snapshot or differential elements.")))
    )
    # headers, elements and rejects each re-read the documents: measured, a
    # second parse is cheaper than writing the VARIANT documents out and back.
    # With the position in this projection filters on the reason stay above it:
    # pushed below, they would repeat every expression it is made of.
    checked = step.select(F.monotonically_increasing_id().alias("doc_pos"), "sd", "url", reason.alias("reason"), now.alias("processedAt"), *(
        _vs(s, f"$.{k}").alias(c) for c, k in _HEADER.items()))
    # dealt by url first: else documents would be sorted in the tasks that read them,
    # and the partitions made few by their compressed size
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ok = checked.where(F.col("reason").isNull()).repartition(parts, "url")
    # the last document of a batch wins for a url, as sequential upserts would
    w_url = Window.partitionBy("url").orderBy(F.col("doc_pos").desc())
    ok = ok.withColumn("_rn", F.row_number().over(w_url)).where("_rn = 1").drop("_rn")
    def_id = F.sha2(F.concat_ws("|", F.col("url"), F.col("processedAt").cast("string")), 256)
    ok = ok.withColumn("id", def_id)
    headers = ok.select("id", "url", "version", "name", "type", "fhirVersion", "description", "processedAt", "resourceId")
    exploded = ok.select(F.col("id").alias("structureDefinitionId"), "url",
                         F.posexplode(_elements(s)).alias("ordinal", "el"))
    # bind each intermediate once (the element as a map, then the chosen keys,
    # then their values): every later expression reads plain columns
    e = F.col("el")
    path = _vs(e, "$.path")
    types = F.try_variant_get(e, "$.type", "array<variant>")
    codes = F.filter(F.transform(types, lambda t: _vs(t, "$.code")), lambda c: c.isNotNull() & (c != ""))
    s1 = exploded.where(path.isNotNull() & (path != "")).select(
        "structureDefinitionId", "url", F.col("ordinal").cast("int").alias("ordinal"), path.alias("path"),
        _vs(e, "$.sliceName").alias("sliceName"), _vs(e, "$.short").alias("shortDescription"),
        _vs(e, "$.definition").alias("definition"), F.coalesce(codes, F.array().cast("array<string>")).alias("dataTypes"),
        F.try_variant_get(e, "$.min", "int").alias("cardinalityMin"), _vs(e, "$.max").alias("cardinalityMax"),
        F.try_variant_get(e, "$", "map<string,variant>").alias("_m"))
    keys = F.map_keys(F.col("_m"))
    s2 = s1.select("*", _first_key(keys, "fixed").alias("_fk"), _first_key(keys, "defaultValue").alias("_dk"))
    s3 = s2.select("*", F.try_element_at(F.col("_m"), F.col("_fk")).alias("_fv"),
                   F.try_element_at(F.col("_m"), F.col("_dk")).alias("_dv"))
    rows = s3.select(
        F.sha2(F.concat_ws("|", F.col("structureDefinitionId"), F.col("ordinal").cast("string")), 256).alias("id"),
        "structureDefinitionId", "url", "ordinal", "path", "sliceName", "shortDescription", "definition", "dataTypes",
        "cardinalityMin", "cardinalityMax",
        F.when(F.col("_fk").isNotNull(), _stored_text(F.col("_fv"))).alias("fixedValue"),
        F.lower(F.expr("substring(_fk, 6)")).alias("fixedValueType"),
        F.when(F.col("_dk").isNotNull(), _stored_text(F.col("_dv"))).alias("defaultValue"),
        F.lower(F.expr("substring(_dk, 13)")).alias("defaultValueType"),
    )
    counts = rows.groupBy("url", "structureDefinitionId").agg(F.count(F.lit(1)).alias("elementCount"))
    # by url, as the rows lie since the choice of documents: no second shuffle
    w_dup = Window.partitionBy("url", "path").orderBy("ordinal")
    deduped = rows.withColumn("_rn", F.row_number().over(w_dup)).where("_rn = 1").drop("_rn", "url")
    rejects = checked.where(F.col("reason").isNotNull()).select("doc_pos", "url", "reason")
    return Ingested(headers, deduped, rejects, counts)


def written(result: Ingested) -> Ingested:
    """The ingest with its definitions and elements written once, for one that is stored or read several times: else its documents are read each time."""
    return Ingested(materialize(result.definitions), materialize(result.elements), result.rejects, result.counts)


def store(result: Ingested, root: str, ingest_id: str | None = None) -> str:
    """K6: add the new versions — elements first, then headers (readers go
    through headers, so a failed run leaves nothing visible).

    Each ingest writes folders of its own, ``ingest=<id>``, and replaces them:
    storing the same ingest again (a retry) changes nothing.  The id, which is
    returned, is by default a digest of the definitions' ids.
    """
    definitions = result.definitions
    if ingest_id is None:
        definitions = materialize(definitions)  # for the digest and the write, or documents would be read twice
        marks = definitions.agg(F.count("*"), F.sum(F.xxhash64("id").cast("decimal(38,0)"))).first()
        ingest_id = hashlib.sha256(f"{marks[0]}:{marks[1]}".encode()).hexdigest()[:32]
    _write(result.elements, root, "definition_elements", ingest_id)
    _write(definitions, root, "definitions", ingest_id)
    return ingest_id


def _write(rows: DataFrame, root: str, table: str, ingest_id: str) -> None:
    keep = [c for c in rows.columns if c not in ("storedAt", "ingest")]
    rows.select(*keep, F.lit(_now()).cast("timestamp").alias("storedAt")).write.mode("overwrite").parquet(f"{root}/{table}/ingest={ingest_id}")


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def append_headers(headers: DataFrame, root: str) -> DataFrame:
    """K7: header-only upsert = add a newer header row (W1 picks it)."""
    _write(headers, root, "definitions", uuid.uuid4().hex)
    return headers


def append_elements(elements: DataFrame, root: str) -> DataFrame:
    """K7: bulk append of element rows; returns the rows appended."""
    _write(elements, root, "definition_elements", uuid.uuid4().hex)
    return elements


def delete_elements(ids: DataFrame, root: str, id_col: str = "structureDefinitionId") -> None:
    """K7: delete the elements of definitions that are stored so far.  A delete adds
    tombstones with their time, which readers hold against the elements';
    nothing is rewritten in place, and what is appended later stays."""
    ids.select(F.col(id_col).alias("structureDefinitionId"), F.lit(_now()).cast("timestamp").alias("deletedAt")) \
        .write.mode("append").parquet(f"{root}/definition_tombstones")


def read_store(spark, root: str) -> tuple[DataFrame, DataFrame]:
    """The stored tables as (definitions, live elements)."""
    from pyspark.errors import AnalysisException

    defs = spark.read.parquet(f"{root}/definitions").drop("storedAt", "ingest")
    els = spark.read.parquet(f"{root}/definition_elements").drop("ingest")
    try:
        dead = spark.read.parquet(f"{root}/definition_tombstones")
    except AnalysisException:  # no delete has been written yet
        return defs, els.drop("storedAt")
    dead = dead.groupBy("structureDefinitionId").agg(F.max("deletedAt").alias("deletedAt"))
    live = els.join(dead.hint("merge"), "structureDefinitionId", "left").where(F.col("deletedAt").isNull() | (F.col("storedAt") > F.col("deletedAt")))
    return defs, live.drop("storedAt", "deletedAt")


def list_definitions(definitions: DataFrame) -> DataFrame:
    """Newest header per url, no elements."""
    return latest_definitions(definitions)


def elements_for(definitions: DataFrame, elements: DataFrame, url: str | None = None,
                 type_: str | None = None, only: str | None = None) -> DataFrame:
    """F5 + W1 + J2 (+ F4 with ``only`` = "mandatory" | "fixed_or_default" | "both"),
    as a DataFrame: elements of the newest definition matching url or type."""
    conds = []
    if url:
        conds.append(F.col("url") == F.lit(url))
    if type_:
        conds.append(F.col("type") == F.lit(type_))
    if not conds:
        return elements.limit(0)
    cond = conds[0]
    for c in conds[1:]:
        cond = cond | c
    pref = F.when(F.col("url") == F.lit(url), 0).otherwise(1) if url else F.lit(1)
    w = Window.orderBy(pref, F.col("processedAt").desc(), F.col("id").desc())
    head = latest_definitions(definitions).where(cond).withColumn("_rn", F.row_number().over(w)) \
        .where("_rn = 1").select(F.col("id").alias("structureDefinitionId"))
    els = elements.join(F.broadcast(head), "structureDefinitionId", "left_semi")
    mand = F.col("cardinalityMin") >= 1
    fod = F.col("fixedValue").isNotNull() | F.col("defaultValue").isNotNull()
    if only == "mandatory":
        els = els.where(mand)
    elif only == "fixed_or_default":
        els = els.where(fod)
    elif only == "both":
        els = els.where(mand & fod)
    return els


def resolve_identifiers(ids: DataFrame, definitions: DataFrame, id_col: str = "identifier") -> DataFrame:
    """C11: classify identifier texts (canonical url vs logical id) and join them
    to the newest stored definition; unresolved rows keep NULL ``url``."""
    ident = F.col(id_col)
    kind = F.when(ident.startswith("http"), F.lit("url")).otherwise(F.lit("id"))
    key = (
        F.when(ident.startswith("http"), ident)
        .when(ident.startswith("StructureDefinition/"), ident.substr(F.lit(21), F.length(ident)))
        .otherwise(ident)
    )
    # equal rows are rows of their own: one candidate is chosen per key before the join
    q = ids.select("*", kind.alias("kind"), key.alias("key"))
    latest = latest_definitions(definitions).select(
        F.col("url").alias("def_url"), F.col("resourceId").alias("def_rid"), F.col("processedAt").alias("def_at"))
    by_url = latest.select(F.col("def_url").alias("_k"), "def_url", "def_at", F.lit("url").alias("_kind"))
    by_id = latest.select(F.col("def_rid").alias("_k"), "def_url", "def_at", F.lit("id").alias("_kind"))
    w = Window.partitionBy("_kind", "_k").orderBy(F.col("def_at").desc_nulls_last(), "def_url")
    cand = by_url.unionByName(by_id).where("_k is not null").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    j = q.join(cand.hint("merge"), (q["key"] == cand["_k"]) & (q["kind"] == cand["_kind"]), "left")
    return j.select(*[q[c] for c in ids.columns], q["kind"], q["key"], F.col("def_url").alias("url"))
