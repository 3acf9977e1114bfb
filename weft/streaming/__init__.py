"""Structured Streaming runs of the same compiled plan.

The mapping is stateless and one-record-in / at-most-one-out, so a stream is
just ``readStream`` → :func:`weft.operators.map_in.map_in` → ``writeStream``.
Both outputs of a micro-batch are written by ``foreachBatch`` into folders
keyed by the batch id with overwrite, so a replayed batch after a failure
replaces its own output instead of duplicating it (idempotent sink).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.map_in import map_in
from weft.plans.config import MappingConfig, Profile
from weft.sinks import counted, tagged
from weft.sources import records


def read_record_stream(spark: SparkSession, path: str, fmt: str = "json", schema: T.StructType | str | None = None,
                       on_malformed: str = "route", max_files_per_trigger: int | None = None) -> DataFrame:
    """X1 source: JSON lines (``fmt='json'``) or CSV files with a header (``fmt='csv'``)
    as one VARIANT column, read as :mod:`weft.sources.records` reads them; or a
    typed stream of files with ``schema``.  Each CSV file has its own header, also one that comes later."""
    r = spark.readStream
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "json" and schema is None:
        return records.json_text_records(r.text(path), records.values_of_lines(F.col("value")), on_malformed)
    if fmt == "csv" and schema is None:
        return records.stream_csv_records(r, path, on_malformed=on_malformed)
    if fmt == "csv":
        r = r.option("header", True).option("escape", '"').option("multiLine", True)
    return r.schema(schema).format(fmt).load(path)


def start_map_in_stream(stream: DataFrame, cfg: MappingConfig, out_dir: str, checkpoint_dir: str,
                        profile: Profile = Profile(), variant_col: str | None = None,
                        available_now: bool = True, code_tables: dict[str, DataFrame] | None = None,
                        value_sets: DataFrame | None = None, counts_dir: str | None = None):
    """X1 + X2: run map-in on a stream and write tagged data/error outputs per batch.

    ``counts_dir``: each batch's counts (A2, :func:`weft.sinks.counted`) are written there, one JSON row in a folder of
    the batch's number, which a batch that is run again replaces."""
    # malformed lines stay in the stream: map-in routes them to the error output (X4 route mode)
    plan = map_in(stream, cfg, profile, variant_col=variant_col, code_tables=code_tables, value_sets=value_sets)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        if counts_dir is None:
            tagged(batch).write.mode("overwrite").partitionBy("type").text(f"{out_dir}/batch={batch_id}")
            return
        rows, seen = counted(batch)
        tagged(rows).write.mode("overwrite").partitionBy("type").text(f"{out_dir}/batch={batch_id}")
        row = batch.sparkSession.createDataFrame([seen.get], "records bigint, data bigint, errors bigint, field_errors bigint")
        row.write.mode("overwrite").json(f"{counts_dir}/batch={batch_id}")

    w = plan.df.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
