"""Record sources (S1-S3, S8): CSV, JSON / NDJSON, inline records, JSON text.

Each reader returns a DataFrame with one VARIANT column ``record`` (dynamic
input, the reference's data model) and ``_corrupt_record`` for rows the
parser could not read, which map-in routes to the error output (R6/Q8)
unless ``on_malformed="fail"``.  Typed input needs no reader here: any
DataFrame can be mapped directly with its own schema.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.coerce import type_cell
from weft.sources.headers import header_catalogue, with_own_headers

RECORD = "record"
CORRUPT = "_corrupt_record"

#: What a well-formed line has nowhere outside its strings: a closed value with
#: something after it that neither goes on nor closes what is around it.
_MORE_FOLLOWS = r"[}\]]\s*[^\s,\]}]"


def _checked(on_malformed: str) -> None:
    if on_malformed not in ("route", "fail"):
        raise ValueError("on_malformed must be 'route' or 'fail'")


def _or_fail(df: DataFrame, on_malformed: str) -> DataFrame:
    """With "fail", the job ends at the first row that couldn't be read."""
    if on_malformed == "route":
        return df
    bad = F.col(CORRUPT).isNotNull()
    stop = F.raise_error(F.concat(F.lit("Malformed record: "), F.col(CORRUPT))).cast(T.VariantType())
    return df.withColumn(RECORD, F.when(bad, stop).otherwise(F.col(RECORD)))


def type_csv_columns(df: DataFrame, cell_typing: bool = True) -> DataFrame:
    """C1 over every string column of a CSV DataFrame → one VARIANT object ``record``."""
    cols = [c for c in df.columns if c != CORRUPT]
    cell = type_cell if cell_typing else (lambda c: F.when(c != "", c.cast("variant")))
    obj = F.to_variant_object(F.struct(*[cell(F.col(f"`{c}`")).alias(c) for c in cols]))
    extra = [F.col(CORRUPT)] if CORRUPT in df.columns else []
    return df.select(obj.alias(RECORD), *extra)


def _csv_options(reader, multi_line: bool, header: bool = True):
    return (reader.option("header", header).option("inferSchema", False).option("multiLine", multi_line).option("escape", '"')
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT))


def _positional(width: int) -> T.StructType:
    """Cells by place, and the text of a row that hasn't just as many."""
    return T.StructType([T.StructField(c, T.StringType()) for c in (*(f"_c{k}" for k in range(width)), CORRUPT)])


def _cells(width: int) -> Column:
    return F.array(*[F.col(f"_c{k}") for k in range(width)])


def _row_text(cells: Column) -> Column:
    """What stands for the text of a row that fits the schema: its cells up to the last one that is there."""
    return F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), ",")


def _same_header(raw: DataFrame, fields: list[tuple[str, int]], width: int, cell_typing: bool) -> DataFrame:
    """Rows of files that all have one header (one cell more than it is read): columns of a typed struct."""
    cell = type_cell if cell_typing else (lambda c: F.when(c != "", c.cast("variant")))
    record = F.to_variant_object(F.struct(*[cell(F.col(f"_c{at}")).alias(name) for name, at in fields]))
    bad = F.when(F.col(f"_c{width}").isNotNull(), F.coalesce(F.col(CORRUPT), _row_text(_cells(width + 1))))
    return raw.select(record.alias(RECORD), bad.alias(CORRUPT))


def _own_header(rows: DataFrame, cell_typing: bool) -> DataFrame:
    """Rows (fields, cells, text) of files with headers of their own: the names are looked up in the row."""
    cell = type_cell if cell_typing else (lambda c: F.when(c != "", c.cast("variant")))
    fields, cells = F.col("fields"), F.col("cells")
    width = F.coalesce(F.array_max(fields["at"]), F.lit(-1)) + 1
    more = F.exists(F.slice(cells, width + 1, F.greatest(F.size(cells) - width, F.lit(0))), lambda c: c.isNotNull())
    values = F.transform(fields["at"], lambda k: cell(F.get(cells, k)))
    return rows.select(F.to_variant_object(F.map_from_arrays(fields["name"], values)).alias(RECORD), F.when(more, F.coalesce(F.col("text"), _row_text(cells))).alias(CORRUPT))


def _routed(typed: DataFrame, on_malformed: str) -> DataFrame:
    return _or_fail(typed.withColumn(RECORD, F.when(F.col(CORRUPT).isNull(), F.col(RECORD))), on_malformed)


def read_csv_records(spark: SparkSession, path: str, cell_typing: bool = True,
                     on_malformed: str = "route", multi_line: bool = True) -> DataFrame:
    """Each file's header row names the fields of its rows, blank lines are skipped, cells typed.

    Files may have other columns or another order of them.  Where all have one header, the
    names are part of the plan; else each row meets its file's header in a join by the file's path.
    Quoted cells may hold separators, line breaks and doubled quotes.  A row
    with fewer cells than the header lacks the last ones; a row with more goes
    whole to ``_corrupt_record``.  With ``multi_line`` a file is one task, so large
    data should come as many files; without it files are split, and no cell
    may hold a line break.  Files that are blank give no rows.
    """
    _checked(on_malformed)
    heads = header_catalogue(spark, path, multi_line)
    known = heads.select("fields").distinct().limit(2).collect()
    reader = _csv_options(spark.read, multi_line)
    if len(known) < 2:
        fields = [(f["name"], f["at"]) for f in known[0]["fields"]] if known else []
        width = 1 + max((at for _, at in fields), default=-1)
        raw = reader.schema(_positional(width + 1)).csv(path)  # one cell more than the header has
        return _routed(_same_header(raw, fields, width, cell_typing), on_malformed)
    width = 1 + heads.agg(F.max(F.array_max("fields.at"))).first()[0] + 1
    raw = reader.schema(_positional(width)).csv(path).select(F.col("_metadata.file_path").alias("file"), _cells(width).alias("cells"), F.col(CORRUPT).alias("text"))
    return _routed(_own_header(raw.join(heads, "file"), cell_typing), on_malformed)


#: Cells of a row that a stream's reader takes apart itself; wider rows are taken apart from their text.
_STREAM_CELLS = 64


def stream_csv_records(reader, path: str, cell_typing: bool = True, on_malformed: str = "route") -> DataFrame:
    """X1 over CSV files, read as :func:`read_csv_records` reads them; a file's header is its first row, also of files that come later."""
    raw = _csv_options(reader, True, header=False).schema(_positional(_STREAM_CELLS)).csv(path)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), _cells(_STREAM_CELLS).alias("cells"), F.col(CORRUPT).alias("text"))
    return _routed(_own_header(with_own_headers(rows, _STREAM_CELLS), cell_typing), on_malformed)


def _top_level_values(text: str) -> list[str]:
    """The texts of the JSON values that follow each other in ``text``; what can't be read is the last of them."""
    out, at, read = [], 0, json.JSONDecoder().raw_decode
    while True:
        while at < len(text) and text[at] in " \t\r\n\ufeff":
            at += 1
        if at == len(text):
            return out
        try:
            _, end = read(text, at)
        except (ValueError, RecursionError):
            return [*out, text[at:]]
        out.append(text[at:end])
        at = end


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split_values(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _top_level_values(t))


def values_of_lines(line: Column) -> Column:
    """The JSON values of a line, as texts.  Lines that hold one value, nearly all, never reach Python."""
    several = line.rlike(_MORE_FOLLOWS)
    return F.coalesce(_split_values(F.when(several, line)), F.array(line))


def values_of_text(text: Column) -> Column:
    """The JSON values of a whole file's text, as texts."""
    return _split_values(text)


def json_text_records(texts: DataFrame, values: Column, on_malformed: str = "route", elements: bool = False) -> DataFrame:
    """Records of a DataFrame's JSON values; with ``elements`` an array gives one record per element."""
    each = texts.select(F.explode(values).alias("_text")).where(F.trim("_text") != "")
    out = parse_json_column(each, "_text")
    if elements:
        many = F.try_variant_get(F.col(RECORD), "$", "array<variant>")
        out = out.select(F.explode(F.coalesce(many, F.array(F.col(RECORD)))).alias(RECORD), CORRUPT)
    return _or_fail(out, on_malformed)


def read_json_records(spark: SparkSession, path: str, multi_line: bool = False,
                      on_malformed: str = "route") -> DataFrame:
    """JSON values line by line (several may share a line) or, with
    ``multi_line``, values of whole files, pretty-printed or not, where a
    top-level array yields one record per element (Q9); a file is then one task."""
    _checked(on_malformed)
    lines = spark.read.text(path, wholetext=multi_line)
    split = values_of_text if multi_line else values_of_lines
    return json_text_records(lines, split(F.col("value")), on_malformed, elements=multi_line)


def parse_json_column(df: DataFrame, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON text column → ``record`` VARIANT; unparsable text keeps its text
    in ``_corrupt_record`` so map-in reports it instead of failing the job."""
    parsed = F.try_parse_json(F.col(text_col))
    return df.select(
        *[F.col(c) for c in keep],
        parsed.alias(RECORD),
        F.when(parsed.isNull() & F.col(text_col).isNotNull(), F.col(text_col)).alias("_corrupt_record"),
    )


def inline_records(spark: SparkSession, records: Iterable[dict]) -> DataFrame:
    """S3: an inline list of objects (at least one) as records."""
    rows = [(json.dumps(r, ensure_ascii=False),) for r in records]
    if not rows:
        raise ValueError("inline data must hold at least one record")
    return parse_json_column(spark.createDataFrame(rows, "text STRING"), "text")
