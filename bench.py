"""Benchmark: headline map-in / map-out / stream runs at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric": "total_sec", "value": N, "unit": "sec",
"queries": {name: sec}, "rows": {name: n}, "records_per_sec": {...}, "sf": ...}.
Every timed run executes the full plan into Spark's ``noop`` sink (or a real
write where the sink is the thing measured); set-up writes are not timed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from weft.operators.map_in import map_in  # noqa: E402
from weft.operators.map_out import map_out  # noqa: E402
from weft.plans.catalog import (  # noqa: E402
    ENCOUNTER_FILL, _encounter_profile, _ingested, _part_configs, cfg, fm)
from weft.session import local_session  # noqa: E402
from weft.sinks import tagged  # noqa: E402
from weft.sources.records import read_json_records  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# A line-item mapping with the usual mix: required id, regex + date reformat,
# code lookup with default, concatenation, numeric passthrough, nested targets.
LINEITEM_CFG = cfg(
    "LineItemToClaimItem", "ClaimResponse",
    fm(0, "l_orderkey", "id", "REQUIRED"),
    fm(1, "l_linenumber", "item[0].itemSequence", "REQUIRED"),
    fm(2, "ship", "item[0].adjudication[0].reason.text", "REGEX", {"pattern": "^\\d{2}/\\d{2}/\\d{4}$"},
       "FORMAT_DATE", {"inputFormat": "dd/MM/yyyy", "outputFormat": "yyyy-MM-dd"}),
    fm(3, "l_returnflag", "outcome", None, None, "CODE_LOOKUP",
       {"map": {"R": "error", "A": "complete", "N": "queued"}, "defaultValue": "partial"}),
    fm(4, "l_linestatus", "status", "MIN_LENGTH", {"min": 1}, "STRING_CASE", {"case": "lower"}),
    fm(5, "l_quantity", "item[0].adjudication[0].value"),
    fm(6, "l_extendedprice", "total[0].amount.value"),
    fm(7, "l_partkey", "identifier[?system='part'].value"),
    fm(8, "l_suppkey", "identifier[?system='supplier'].value"),
    fm(9, "l_orderkey", "request.display", None, None, "CONCATENATE",
       {"fieldsToConcat": ["l_orderkey", "l_linenumber", "l_returnflag"], "separator": "-"}),
)


def lineitem(spark):
    li = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                     "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "dd/MM/yyyy").alias("ship"))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, os.environ.get("BENCH_SHUFFLE_PARTITIONS", CPUS), app="weft-bench")
    scratch = tempfile.mkdtemp(prefix="weft-bench-", dir=os.environ.get("BENCH_SCRATCH", "/tmp"))
    times: dict[str, float] = {}
    cold: dict[str, float] = {}
    rows: dict[str, int] = {}

    def timed(name, fn, n=None):
        # each run twice: the first pays JIT warm-up of the generated code
        # (reported as "cold"), the second is the steady state ("queries")
        for label in ("cold", "warm"):
            t0 = time.time()
            fn()
            (cold if label == "cold" else times)[name] = round(time.time() - t0, 3)
        if n is not None:
            rows[name] = n

    n_li = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    n_ord = spark.read.parquet(f"{SF_DIR}/orders.parquet").count()
    n_ev = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    # warm-up (JVM, file listing) on a small slice of the work, not timed
    run(map_in(lineitem(spark).limit(1000), LINEITEM_CFG, keep_original=False).df)

    # 1. map-in, typed backend
    timed("map_in_typed", lambda: run(map_in(lineitem(spark), LINEITEM_CFG).df), n_li)

    # 2. map-in, VARIANT backend over the same rows as NDJSON (set-up write not timed)
    nd = f"{scratch}/lineitem_ndjson"
    lineitem(spark).write.mode("overwrite").json(nd)
    timed("map_in_variant", lambda: run(map_in(read_json_records(spark, nd).drop("_corrupt_record"),
                                               LINEITEM_CFG, variant_col="record").df), n_li)

    # 3. map-in with profile auto-fill and mandatory check (orders)
    def orders_fill():
        o = spark.read.parquet(f"{SF_DIR}/orders.parquet").select(
            "o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("s"), "o_orderpriority")
        run(map_in(o, ENCOUNTER_FILL, _encounter_profile("fill")).df)

    timed("map_in_profile", orders_fill, n_ord)

    # 4. map-out over the resources of run 1 (materialised once, not timed)
    res_path = f"{scratch}/resources"
    map_in(lineitem(spark), LINEITEM_CFG, keep_original=False).data.select("item.*") \
        .write.mode("overwrite").parquet(res_path)
    out_cfg = cfg("ClaimToRow", "ClaimResponse", fm(0, "order.id", "id"), fm(1, "order.line", "item[0].itemSequence"),
                  fm(2, "order.outcome", "outcome"), fm(3, "part", "identifier[?system='part'].value"),
                  fm(4, "amount", "total[0].amount.value"), direction="FROM_FHIR")
    timed("map_out", lambda: run(map_out(spark.read.parquet(res_path), out_cfg).df), n_li)

    # 5. tagged NDJSON sink (K1) with the data/error split as partition folders (K2)
    timed("sink_ndjson_split", lambda: tagged(map_in(lineitem(spark), LINEITEM_CFG).df)
          .write.mode("overwrite").partitionBy("type").text(f"{scratch}/tagged"), n_li)

    # 6. streaming map-in (availableNow) over events
    ev_cfg = cfg("EventToObservation", "Observation", fm(0, "event_id", "id", "REQUIRED"),
                 fm(1, "event_type", "code.text", None, None, "STRING_CASE", {"case": "upper"}),
                 fm(2, "user_id", "subject.reference"), fm(3, "value", "valueQuantity.value"))

    def stream():
        schema = spark.read.parquet(f"{SF_DIR}/events.parquet").schema
        src = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF_DIR)
        plan = map_in(src, ev_cfg)
        ck = tempfile.mkdtemp(prefix="ev_ckpt-", dir=scratch)
        q = (tagged(plan.df).writeStream.format("noop").option("checkpointLocation", ck)
             .trigger(availableNow=True).start())
        q.awaitTermination()

    timed("stream_map_in", stream, n_ev)

    # 7. control plane: profile ingest + mapping check over part-derived documents
    timed("definition_ingest", lambda: run(_ingested(spark, SF_DIR).elements))

    def check():
        from weft.operators.check import check_mappings

        configs, fms = _part_configs(spark, SF_DIR)
        r = _ingested(spark, SF_DIR)
        run(check_mappings(configs, fms, r.definitions, r.elements))

    timed("mapping_check", check)

    total = round(sum(times.values()), 3)
    rps = {k: round(rows[k] / times[k]) for k in rows if times[k] > 0}
    sf = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": times, "cold": cold,
                      "rows": rows, "records_per_sec": rps, "sf": float(sf.group(1)) if sf else SF_DIR,
                      "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
