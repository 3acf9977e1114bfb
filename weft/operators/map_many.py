"""Many configs in one run (J3): records that name their mapping.

The records are read and parsed once and dealt to a folder per config (a
partitioned table in the shared scratch folder), without a shuffle: tasks write what
they have of each config, so a config that a third of the records name is as
many files as it has tasks.  Each config is then compiled over its own folder,
which only its branch reads.  Records whose config isn't part of the run are
errors, as are those that name none.

A config and its profile are read once per job and config, never per record.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.map_in import CORRUPT, ERRORS_TYPE, SYSTEM_TARGET, error_struct, map_in, original_json
from weft.plans.config import MappingConfig, Profile
from weft.session import scratch_path


def _free(columns: list[str], name: str) -> str:
    while name in {c.lower() for c in columns}:
        name += "_"
    return name


def map_in_many(
    df: DataFrame,
    config: Column,
    configs: Mapping[str, MappingConfig | tuple[MappingConfig, Profile]],
    variant_col: str | None = None,
    keep: tuple[str, ...] = (),
    keep_original: bool = True,
    code_tables: dict[str, DataFrame] | None = None,
    value_sets: DataFrame | None = None,
) -> DataFrame:
    """``config``, the ``keep`` columns, ``item`` (VARIANT: configs make different resources), ``errors`` and ``original`` of every record.

    ``config`` is the expression that names a record's mapping; ``configs`` the mappings of the run, with
    a profile where they have one.  What :func:`weft.operators.map_in.map_in` gives for a config is what its records get here; a record
    of an unknown config has one error and no item.  An empty table gives no rows.
    """
    if "config" in keep:
        raise ValueError("a kept column must not be named 'config'")
    spark = df.sparkSession
    name, known = _free(df.columns, "_config"), _free(df.columns, "_known")
    folder = scratch_path(spark, f"configs/{uuid.uuid4().hex}")
    # folders are named by the config's number, as its name may hold any character; -1: not of this run
    number = {n: k for k, n in enumerate(configs)}
    place = F.coalesce(F.try_element_at(F.create_map(*[x for n, k in number.items() for x in (F.lit(n), F.lit(k))]), F.col(name)), F.lit(-1)) if number else F.lit(-1)
    df.withColumn(name, config.cast("string")).withColumn(known, place.cast("int")).write.partitionBy(known).parquet(folder)
    dealt = spark.read.schema(df.withColumn(name, F.lit("")).withColumn(known, F.lit(0)).schema).parquet(folder)

    branches = []
    for n, k in number.items():
        own = configs[n]
        cfg, profile = own if isinstance(own, tuple) else (own, Profile())
        rows = dealt.where(F.col(known) == k).drop(name, known)
        got = map_in(rows, cfg, profile, variant_col=variant_col, keep=keep, keep_original=keep_original, code_tables=code_tables, value_sets=value_sets).df
        branches.append(got.select(F.lit(n).alias("config"), *[F.col(f"`{c}`") for c in keep], F.parse_json(F.to_json("item")).alias("item"), "errors", "original"))
    lost = dealt.where(F.col(known) == -1)
    original = original_json(lost.drop(name, known), variant_col) if keep_original else F.lit(None).cast("string")
    if CORRUPT in df.columns and keep_original:
        original = F.coalesce(F.col(CORRUPT), original)
    message = F.when(F.col(name).isNull(), F.lit("The record names no mapping configuration.")).otherwise(F.concat(F.lit("Mapping configuration '"), F.col(name), F.lit("' not found")))
    error = error_struct(None, SYSTEM_TARGET, F.to_json(F.struct(F.col(name).alias("config"))), "Transformation", message, None)
    branches.append(lost.select(F.col(name).alias("config"), *[F.col(f"`{c}`") for c in keep], F.lit(None).cast("variant").alias("item"), F.array(error).cast(ERRORS_TYPE).alias("errors"), original.alias("original")))
    return reduce(DataFrame.unionByName, branches)
