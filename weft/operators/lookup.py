"""Table-driven code lookup (J4, large form of T4).

A CODE_LOOKUP map in a mapping config is compiled into a literal map
expression.  When the codes live in a table instead, the lookup is a left
join plus a default.  Keys and codes are compared as the texts a config would
hold, so a number matches the code that spells it.  Spark picks the join by the
sizes it measures (``spark.sql.autoBroadcastJoinThreshold``, AQE, skew splits).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.coerce import js_string
from weft.functions.paths import Val
from weft.session import materialize


def code_lookup_table(df: DataFrame, key: str, codes: DataFrame, code_key: str, code_value: str,
                      out: str, default=None) -> DataFrame:
    """Add ``out`` = codes[code_value] where codes[code_key] is the text of df[key], else ``default``.
    Duplicate code keys keep one value (first by value order) so rows never multiply."""
    as_text = lambda d, c: js_string(Val(F.col(f"`{c}`"), d.schema[c].dataType))
    c = codes.groupBy(as_text(codes, code_key).alias("_lk")).agg(F.min(F.col(f"`{code_value}`")).alias("_lv"))
    j = df.withColumn("_key", as_text(df, key)).join(c, F.col("_key") == F.col("_lk"), "left")
    val = F.col("_lv") if default is None else F.coalesce(F.col("_lv"), F.lit(default))
    return j.withColumn(out, val).drop("_lk", "_lv", "_key")


def value_set_codes(value_sets: DataFrame, urls: set[str]) -> dict[str, DataFrame]:
    """The codes (``_lk``, as texts) of those of ``urls`` that ``value_sets`` (url, code) has any of.

    The codes of all sets are written once, each code once a set; a set is a filter of that table, joined as Spark sees fit (see :func:`distinct_codes`).
    """
    text = js_string(Val(F.col("code"), value_sets.schema["code"].dataType))
    own = value_sets.where(F.col("url").isin(sorted(urls))).select("url", text.alias("_lk")).where("_lk is not null")
    held = materialize(own.distinct())
    known = {r.url for r in held.select("url").distinct().collect()}  # of the config's urls
    return {u: held.where(F.col("url") == u).select("_lk") for u in known}


def distinct_codes(codes: DataFrame, key: str = "code", value: str = "value") -> DataFrame:
    """``_lk`` (the code's text) and ``_lv`` once each; of several values of a code the least.

    The table is written, so that Spark knows its size: it is broadcast below
    ``spark.sql.autoBroadcastJoinThreshold``, and beyond it both sides of the join are plain
    shuffles, where AQE can split a code that very many records have.
    """
    text = js_string(Val(F.col(f"`{key}`"), codes.schema[key].dataType))
    return materialize(codes.select(text.alias("_lk"), F.col(f"`{value}`").alias("_lv")).where("_lk is not null").groupBy("_lk").agg(F.min("_lv").alias("_lv")))
