"""Plain versions of what the operators compute, and awkward rows that all of them must take."""

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})

#: Columns that bear names operators use for their own output.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, hits string, verdict string, toxicity int, language string, quality string, license string, _set int, sequence_id string"

LONG = " ".join(f"word{i % 977} Thing{i % 31}." for i in range(30_000))
AWKWARD = [None, "", " \n\t ", "!!! ???", "a", "a b c", "é ü 日本語", LONG, "same text again and once more\nsame text again and once more", "same text again and once more\nsame text again and once more"]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def awkward(spark, more=(), texts=AWKWARD):
    """Awkward texts with null and repeated ids, nulls elsewhere, and clashing columns."""
    rows = [(None if i == 4 else min(i, 8), t, None if i % 3 else "en", None, None, 0.5, "x", None, 7, "y", None, "z", 1, "s") for i, t in enumerate([*texts, *more])]
    return spark.createDataFrame(rows, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")
