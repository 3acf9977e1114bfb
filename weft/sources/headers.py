"""The header of each CSV file: which names its cells have.

Files of a folder may have other columns, or the same in another order, so a
header is bound to its own file by ``_metadata.file_path``:

* :func:`header_catalogue` finds the headers of a batch's files, one row per file, from their first lines.
* :func:`with_own_headers` takes a file's first row for its header while the
  rows go by, for streams, where files come that no catalogue knows.  A
  ``multiLine`` file is read by one task from its beginning, so its header comes first.

A header is a list of (name, place of the cell).  A blank name is ``_c<place>``,
and of equal names the last one counts, as when an object's key is set again.
"""

from __future__ import annotations

import csv

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("at", T.IntegerType())]))
_ARROW_FIELDS = pa.list_(pa.struct([("name", pa.string()), ("at", pa.int32())]))
_BOM = "﻿"


def cells_of(text: str) -> list[str]:
    """The cells of one CSV record."""
    return next(csv.reader(text.splitlines(keepends=True)), [])


def fields_of(names: list[str | None]) -> list[tuple[str, int]]:
    """The header's fields in the order of their places; of equal names the last."""
    at = {}
    for k, n in enumerate(names):
        n = (n or "").removeprefix(_BOM) if k == 0 else n or ""
        name = n if n.strip() else f"_c{k}"
        at.pop(name, None)
        at[name] = k
    return list(at.items())


@F.pandas_udf(FIELDS)
def _fields(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"name": n, "at": k} for n, k in fields_of(cells_of(t))])


def header_catalogue(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """``file`` and ``fields`` of every file that isn't blank.

    Lines are read as text and only those of a file's first block go on; the first
    that isn't blank is kept by task, so one narrow row per file is shuffled.  Where that line
    leaves a quote open (``multi_line`` only) the header has a line break in it, and that file
    is read whole for the rest of the header.
    """
    place = F.col("_metadata.file_path")
    lines = spark.read.text(path).where((F.col("_metadata.file_block_start") == 0) & (F.trim(F.regexp_replace("value", f"^{_BOM}", "")) != ""))
    heads = lines.select(place.alias("file"), "value").groupBy("file").agg(F.first("value").alias("head"))
    if multi_line:
        open_ = (F.length("head") - F.length(F.replace("head", F.lit('"'), F.lit("")))) % 2 == 1
        whole = spark.read.text(path, wholetext=True).select(place.alias("file"), F.regexp_extract("value", r'^\s*((?:[^"\r\n]|"[^"]*")*)', 1).alias("all"))
        broken = heads.where(open_).join(whole, "file").select("file", F.col("all").alias("head"))
        if not heads.where(open_).isEmpty():
            heads = heads.where(~open_).unionByName(broken)
    return heads.select("file", _fields("head").alias("fields"))


_ROWS = T.StructType([T.StructField("fields", FIELDS), T.StructField("cells", T.ArrayType(T.StringType())), T.StructField("text", T.StringType())])


def with_own_headers(rows: DataFrame, width: int) -> DataFrame:
    """Rows of whole files (``file``, ``cells``, ``text``: the row as read, where it isn't ``width`` cells) without their first ones, with the ``fields`` these name.

    A row with more than ``width`` cells has its text only, and is taken apart here.
    """

    def run(batches):
        file, fields = None, None
        for b in batches:
            if not b.num_rows:
                continue
            files, cells, text = b.column(0), b.column(1), b.column(2)
            wide = [i for i, t in enumerate(text.to_pylist()) if t is not None and t.count(",") >= width]
            if wide:
                values = cells.to_pylist()
                for i in wide:
                    values[i] = [x or None for x in cells_of(text[i].as_py())]
                cells = pa.array(values, pa.list_(pa.string()))
            names = files.to_pylist()
            bounds = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if names[lo] != file:
                    file, head = names[lo], text[lo].as_py()
                    head = cells[lo].as_py() if head is None else cells_of(head)
                    fields = [{"name": n, "at": k} for n, k in fields_of(head)]
                    lo += 1
                if lo < hi:
                    n = hi - lo
                    own = pa.array([fields], _ARROW_FIELDS).take(pa.array(np.zeros(n, dtype=np.int32)))
                    yield pa.RecordBatch.from_arrays([own, cells.slice(lo, n), text.slice(lo, n)], names=_ROWS.names)

    return rows.select("file", "cells", "text").mapInArrow(run, _ROWS)
